"""Streaming ingestion of call edges (an extension; the batch operators run on the tables it keeps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_edges(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of (ts timestamp, file string, src string, dst string) as they come."""
    return spark.readStream.schema("ts timestamp, file string, src string, dst string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_edges(edges: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each edge once within the lateness: state is dropped behind the watermark."""
    return edges.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["file", "src", "dst"])


def fan_in(edges: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Edges and distinct callers of each callee by window of time."""
    timed = edges.withWatermark("ts", lateness).groupBy(F.window("ts", window), "dst")
    return timed.agg(F.count("*").alias("edges"), F.approx_count_distinct("src").alias("callers"))


def write_edges(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return edges.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
