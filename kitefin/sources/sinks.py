"""Sinks: advice by subsystem, DOT text, symbol lists, module lists, settings files."""

from __future__ import annotations

import configparser
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import render_dot
from .text_lines import latest_modification


def write_advice(advice: DataFrame, path: str) -> None:
    """Parquet partitioned by subsystem, so that a directory's result is read alone."""
    advice.write.mode("overwrite").partitionBy("subsystem").parquet(path)


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Body lines of a DOT graph as text files; nodes come as written, before edges only within a file."""
    render_dot(nodes, edges).write.mode("overwrite").text(path)


def write_symbol_lists(labels: DataFrame, path: str) -> None:
    """One folder of text files a label, one name a line, each name once."""
    rows = labels.select("label", "name").distinct().repartition("label").sortWithinPartitions("label", "name")
    rows.select("label", F.col("name").alias("value")).write.mode("overwrite").partitionBy("label").text(path)


def write_module_lists(summaries: DataFrame, zero: DataFrame, path: str) -> None:
    """All subsystems, those with nothing to move, and the rest, which is what gets rewritten."""
    every = summaries.select("subsystem").distinct()
    for name, rows in (("all", every), ("zero", zero.select("subsystem")), ("todo", every.join(zero.select("subsystem"), "subsystem", "left_anti"))):
        rows.sort("subsystem").write.mode("overwrite").text(f"{path}/{name}")


def reuse(spark: SparkSession, sources: str, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written anew if a file below sources has changed since, or if there is none yet."""
    changed = latest_modification(spark, sources).first().latest
    try:
        written = latest_modification(spark, path).first().latest
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        written = None
    if written is None or changed is not None and changed > written:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_settings(path: str) -> dict[str, dict[str, str]]:
    parser = configparser.ConfigParser()
    parser.optionxform = str
    if not parser.read(path):
        raise FileNotFoundError(path)
    return {s: dict(parser[s]) for s in parser.sections()}


def update_settings(path: str, section: str, **values: str) -> None:
    parser = configparser.ConfigParser()
    parser.optionxform = str
    parser.read(path)
    if not parser.has_section(section):
        parser.add_section(section)
    for key, value in values.items():
        parser.set(section, key, value)
    with open(path, "w") as f:
        parser.write(f)
