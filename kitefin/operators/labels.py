"""Labels: priority join, set operations over name lists, files of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_syscall, is_trace, is_virtual_init
from ..schema import DEFAULT_TYPE, LABEL_PRIORITY
from ..shared import by_key


def label_types(nodes: DataFrame, labels: DataFrame, priority: tuple[str, ...] = LABEL_PRIORITY) -> DataFrame:
    """nodes with `type`: the label of highest priority, else the default."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("label"))
    # Reduced to one row a name first, so that the join adds no rows.
    best = labels.filter(F.col("label").isin(*priority)).groupBy("name").agg(F.min_by("label", rank).alias("type"))
    return nodes.drop("type").join(by_key(best), "name", "left").withColumn("type", F.coalesce("type", F.lit(DEFAULT_TYPE)))


def names(labels: DataFrame, *wanted: str) -> DataFrame:
    return labels.filter(F.col("label").isin(*wanted)).select("name").distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").distinct().join(by_key(b.select("name")), "name", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").distinct().join(by_key(b.select("name")), "name", "left_anti")


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("name")
    for s in sets[1:]:
        out = out.unionAll(s.select("name"))
    return out.distinct()


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, `equal`: both sets have the same names."""
    sides = a.select("name").distinct().withColumn("side", F.lit(1)).unionAll(b.select("name").distinct().withColumn("side", F.lit(2)))
    odd = sides.groupBy("name").agg(F.sum("side").alias("sides")).filter("sides <> 3")
    return odd.agg((F.count("*") == 0).alias("equal"))


def untraced(universe: DataFrame) -> DataFrame:
    """Names without tracing, system calls and initialisers."""
    name = F.col("name")
    return universe.filter(~(is_trace(name) | is_syscall(name) | is_virtual_init(name)))


def declared_in(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct names declared in files (file)."""
    return nodes.join(files.select("file").distinct(), "file", "left_semi").select("name").distinct()


def unexported(used: DataFrame, exported: DataFrame, own: DataFrame) -> DataFrame:
    """Used names (func, name) that are neither exported nor the module's own."""
    return used.join(exported.select("name"), "name", "left_anti").join(own.select("name"), "name", "left_anti").select("name").distinct()
