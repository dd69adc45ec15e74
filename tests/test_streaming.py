"""Streaming ingestion of edges."""

from datetime import datetime

from kitefin.streaming import edges as S


def test_edges_are_kept_once(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at, "f", "a", "b"), (at, "f", "a", "b"), (at, "f", "c", "b")]
    spark.createDataFrame(rows, "ts timestamp, file string, src string, dst string").write.parquet(str(tmp_path / "in"))
    query = S.write_edges(S.new_edges(S.read_edges(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_fan_in(spark, tmp_path):
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(at, "f", "a", "b"), (at, "f", "c", "b")], "ts timestamp, file string, src string, dst string").write.parquet(str(tmp_path / "in"))
    query = S.fan_in(S.read_edges(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("fan_in").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    (row,) = spark.sql("SELECT dst, edges, callers FROM fan_in").collect()
    assert tuple(row) == ("b", 2, 2)
