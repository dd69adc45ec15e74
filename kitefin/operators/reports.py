"""Summaries of advice and of code generation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import all_zero, depth
from ..schema import RECOMMENDATIONS
from ..shared import by_key, checkpoint

COUNTS = ("SUBGRAPH", "INTERFACE", "DELETE", "NORMAL")


def summary(advice: DataFrame) -> DataFrame:
    """Components and recommendations of each subsystem, from advice (subsystem, name, recommendation, component)."""
    count = [F.count_if(F.col("recommendation") == r).alias(r) for r in RECOMMENDATIONS]
    return advice.groupBy("subsystem").agg(F.count_distinct("component").alias("SUBGRAPH"), *count).select("subsystem", *COUNTS)


def total(summaries: DataFrame) -> DataFrame:
    """Sums over top-level directories only, since deeper ones are part of them."""
    return summaries.filter(depth(F.col("subsystem")) == 1).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))


def all_zero_subsystems(summaries: DataFrame) -> DataFrame:
    return summaries.filter(all_zero(*map(F.col, COUNTS))).select("subsystem")


def completed(summaries: DataFrame, subsystems: DataFrame) -> DataFrame:
    """summaries with a row of zeros for each subsystem that has none."""
    every = subsystems.select("subsystem").distinct().join(summaries, "subsystem", "left")
    return every.select("subsystem", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))


def functions_by_file(located: DataFrame) -> DataFrame:
    """real_file, functions: (start_loc, name) of each file's functions, from the last up."""
    return located.groupBy("real_file").agg(F.sort_array(F.collect_list(F.struct("start_loc", "name")), False).alias("functions"))


def files_of(names: DataFrame, declared: DataFrame) -> DataFrame:
    """names (name, ...) with the file that declares each, the least of several; null where none is known. declared: name, file."""
    return names.join(declared.groupBy("name").agg(F.min("file").alias("file")), "name", "left")


def numbered(df: DataFrame, name: str, keys: tuple[str, ...], *order) -> DataFrame:
    """df with rows numbered from 0 within keys, in an order that has no ties, without a task that sees them all.

    Rows are dealt by range and counted in each part; a part's number is its place among parts, of which there are few, and
    a row's is that of its part and its place there.
    """
    by = [*keys, *order]
    placed = checkpoint(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    held = placed.join(offsets, part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_before")
    if not keys:
        return held
    first = held.groupBy(*keys).agg(F.min(name).alias("_first"))
    return held.join(first, list(keys)).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def rank_components(members: DataFrame, *keys: str) -> DataFrame:
    """Members with `rank`: components by size, largest first, then by least name, from 0; [keys...,] name, component."""
    sizes = members.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    ranked = numbered(sizes, "rank", keys, F.desc("size"), F.col("component"))
    return members.join(by_key(ranked.withColumn("rank", F.col("rank").cast("int"))), [*keys, "component"])


def locate(advice: DataFrame, locations: DataFrame) -> DataFrame:
    """Advice with (real_file, start_loc, end_loc) of locations (name, ...), functions of a file from the last up."""
    order = Window.partitionBy("real_file").orderBy(F.desc("start_loc"), "name")
    return advice.join(locations, "name").withColumn("turn", F.row_number().over(order))


def unlocated(advice: DataFrame, locations: DataFrame) -> DataFrame:
    return advice.join(locations, "name", "left_anti").select("name")


def handled(runs: DataFrame) -> DataFrame:
    """Functions handled with success by way, from runs (handle_way, ok)."""
    return runs.groupBy("handle_way").agg(F.count_if("ok").alias("handled"))


def handle_way(recommendation):
    """Functions that could go are kept behind an interface like the others that are called from outside."""
    return F.when(recommendation == "DELETE", "INTERFACE").otherwise(recommendation)


def merged_includes(includes: DataFrame, *keys: str) -> DataFrame:
    """Includes of several files as one list without repeats, in the order in which they come first."""
    firsts = includes.groupBy(*keys, "target").agg(F.min(F.struct("file", "ordinal")).alias("at"))
    placed = numbered(firsts, "position", keys, F.col("at.file"), F.col("at.ordinal"), F.col("target"))
    return placed.select(*keys, "target", (F.col("position") + 1).cast("int").alias("position"))
