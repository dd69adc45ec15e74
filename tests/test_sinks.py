"""Sinks and the command line, end to end on files."""

from kitefin.__main__ import main
from kitefin.sources import graphs, sinks, text_lines


def test_symbol_lists(spark, tmp_path):
    rows = spark.createDataFrame([("INIT", "b"), ("INIT", "a"), ("INIT", "a"), ("TRACE", "c")], "label string, name string")
    sinks.write_symbol_lists(rows, str(tmp_path / "l"))
    back = spark.read.text(str(tmp_path / "l" / "label=INIT"))
    assert sorted(r.value for r in back.collect()) == ["a", "b"]


def test_dot_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a.1", "/x/f", "INIT", None), ("b", None, None, None)], "name string, file string, type string, recommendation string")
    edges = spark.createDataFrame([("a.1", "b")], "src string, dst string")
    sinks.write_dot(nodes, edges, str(tmp_path / "g"))
    lines = spark.read.text(str(tmp_path / "g")).withColumnRenamed("value", "text")
    back, e = graphs.dot(lines)
    assert sorted(map(str, back.collect())) == sorted(map(str, nodes.collect())) and [tuple(x) for x in e.collect()] == [("a.1", "b")]


def test_settings(tmp_path):
    path = str(tmp_path / "c.ini")
    sinks.update_settings(path, "DEFAULT_DIRS", Src="/x", merge="True")
    sinks.update_settings(path, "DEFAULT_DIRS", merge="False")
    assert sinks.read_settings(path) == {"DEFAULT_DIRS": {"Src": "/x", "merge": "False"}}


def test_command_line(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "a.txt").write_text("a@isDefinition -> b@isDefinition \nb@isDefinition -> x@isDeclaration \n")
    (tmp_path / "txt" / "b.txt").write_text("a@isDefinition -> c@isDefinition \n")
    main(["combine", "-i", str(tmp_path / "txt"), "-o", str(tmp_path / "whole")])
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "whole" / "nodes")).collect()) == ["a", "b", "c", "x"]
    main(["partition", "-i", str(tmp_path / "whole" / "edges"), "-o", str(tmp_path / "parts")])
    assert {r.component for r in spark.read.parquet(str(tmp_path / "parts")).collect()} == {"a"}
    at = str(tmp_path / "in")
    spark.createDataFrame([("a", "/d/f"), ("b", "/d/f"), ("c", "/e/f")], "name string, file string").write.parquet(f"{at}/nodes")
    spark.createDataFrame([("/d/f", "a", "b")], "file string, src string, dst string").write.parquet(f"{at}/edges")
    spark.createDataFrame([("EXPORT", "a"), ("INIT", "c")], "label string, name string").write.parquet(f"{at}/labels")
    main(["advise", "-i", at, "-o", str(tmp_path / "out")])
    advice = spark.read.parquet(str(tmp_path / "out" / "advice")).collect()
    assert [(r.subsystem, r.name, r.recommendation) for r in advice] == [("/d", "b", "INTERFACE")]
    assert text_lines.symbol_list(spark.read.text(str(tmp_path / "out" / "modules" / "zero")).withColumnRenamed("value", "text")).collect()[0].name == "/e"
