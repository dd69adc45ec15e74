"""Advice for all directories bottom-up: each edge counts once, at the deepest directory that holds both its ends.

A function's callers tell from which depth on it is an entry: a directory lacks a caller if it is deeper than what the
two have in common. A function is deleted where a directory holds all that leads to it, without a cycle, so the depth
that all of those have in common decides. Components are merged from the deepest directories up: a level joins
the components that its own edges lead between, and an absorbed component knows its level and what it went into. Only
the advice itself is written out for each directory above a function.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import path_prefixes
from ..operators import hierarchy
from ..operators.iterate import SMALL_EDGES, components, is_small, peel
from ..shared import by_key, checkpoint
from .advise import KEPT


def _folders(file: Column) -> Column:
    """Names of the directories above a file, from the top."""
    parts = F.split(F.regexp_replace(file, "^/", ""), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _shared(a: Column, b: Column) -> Column:
    """How many directories two lists begin with alike."""
    least = F.least(F.size(a), F.size(b))
    alike = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda n: (n <= least) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)))
    return F.size(alike)


def _absorbed(edges: DataFrame, small_edges: int) -> DataFrame:
    """old, new, level: components (by least name) that a directory's depth joins into others, each once."""
    held: DataFrame | None = None
    levels = sorted((r.common for r in edges.select("common").distinct().collect()), reverse=True)  # depths of directories
    for level in levels:
        at = edges.filter(F.col("common") == level).select("src", "dst")
        for end in ("src", "dst"):
            while held is not None:
                up = held.select(F.col("old").alias(end), "new")
                moved = checkpoint(at.join(by_key(up), end, "left"))
                at = moved.withColumn(end, F.coalesce("new", end)).drop("new")
                if moved.filter("new is not null").isEmpty():
                    break
        apart = checkpoint(at.filter("src <> dst").distinct())
        ends = apart.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
        new = components(apart, ends, small_edges=small_edges).filter("name <> component").select(F.col("name").alias("old"), F.col("component").alias("new"), F.lit(level).alias("level"))
        held = checkpoint(new if held is None else held.unionByName(new))
    return held


def advise_rollup(nodes: DataFrame, edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """subsystem, name, recommendation, component of all movable functions for each directory above their file.

    nodes: name, file, type; edges: src, dst of the whole graph. A name is in one file, the least if several have it. The
    rows are those of `advise` over `by_subsystem`.
    """
    one = nodes.groupBy("name").agg(F.min(F.struct("file", "type")).alias("at")).select("name", "at.file", "at.type")
    kept = checkpoint(one.filter(F.col("type").isin(*KEPT)).select("name", "file", _folders(F.col("file")).alias("above")))
    place = lambda c: kept.select(F.col("name").alias(c), F.col("above").alias(f"{c}_above"))
    ends = edges.select("src", "dst").distinct().join(by_key(place("dst")), "dst").join(by_key(place("src")), "src", "left")
    common = F.when(F.col("src_above").isNotNull(), _shared(F.col("src_above"), F.col("dst_above"))).otherwise(0)
    calls = checkpoint(ends.select("src", "dst", F.col("src_above").isNotNull().alias("inner"), common.alias("common")))
    entries = calls.groupBy(F.col("dst").alias("name")).agg(F.min("common").alias("entry_below"))
    inner = calls.filter("inner").select("src", "dst")
    # Functions that nothing but movable ones without cycles lead to, and what directories all of those share.
    open_ = calls.filter("not inner").select(F.col("dst").alias("name")).distinct()
    gone = checkpoint(peel(inner, kept, open_, small_edges=small_edges))
    closed = inner.join(by_key(gone.withColumnRenamed("name", "dst")), "dst", "left_semi").select(F.lit(0).alias("key"), "src", "dst")
    said = kept.join(by_key(gone), "name", "left_semi").select(F.lit(0).alias("key"), "name", F.array_join(F.transform("above", lambda d: F.concat(d, F.lit("/"))), "").alias("lo")).withColumn("hi", F.col("lo"))
    spans = hierarchy.extremes(checkpoint(closed), said, functools.partial(is_small, most=small_edges), checkpoint)
    folders = lambda c: F.filter(F.split(c, "/"), lambda d: d != "")
    deleted = spans.select("name", _shared(folders(F.col("lo")), folders(F.col("hi"))).alias("deleted_to"))
    absorbed = _absorbed(calls.filter("inner and common > 0 and src <> dst"), small_edges)
    # The components that a function goes through, from its own name up.
    path, at = kept.select("name").withColumn("steps", F.array().cast("array<struct<level:int,into:string>>")), []
    if absorbed is not None:
        step = absorbed.select(F.col("old").alias("label"), "new", "level")
        path = kept.select("name", F.col("name").alias("label"), F.array().cast("array<struct<level:int,into:string>>").alias("steps"))
        while True:
            moved = checkpoint(path.join(by_key(step), "label", "left"))
            at.append(moved.filter("new is null").select("name", "steps"))
            path = moved.filter("new is not null").select("name", F.col("new").alias("label"), F.concat("steps", F.array(F.struct("level", F.col("new").alias("into")))).alias("steps"))
            if path.isEmpty():
                break
        path = functools.reduce(DataFrame.unionByName, at)
    rows = kept.join(by_key(entries), "name", "left").join(by_key(deleted), "name", "left").join(by_key(path), "name")
    rows = rows.select("name", "entry_below", "deleted_to", "steps", F.posexplode(path_prefixes(F.col("file"))).alias("depth", "subsystem")).withColumn("depth", F.col("depth") + 1)
    said = F.when(F.col("depth") > F.col("entry_below"), "INTERFACE").when(F.col("depth") <= F.col("deleted_to"), "DELETE").otherwise("NORMAL")
    into = F.try_element_at(F.filter("steps", lambda s: s["level"] >= F.col("depth")), F.lit(-1))["into"]
    return rows.select("subsystem", "name", said.alias("recommendation"), F.coalesce(into, "name").alias("component"))
