"""Set-at-a-time graph operators over edges (src, dst) and nodes (name, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DESTINATION, EXTERNAL, NON_MODULAR, SOURCE, VIRTUAL
from ..shared import by_key


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    turned = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*(turned.get(c, F.col(c)) for c in edges.columns))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst")))


def endpoints(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct (keys..., name) of both ends, in one pass over the edges."""
    return edges.select(*keys, F.explode(F.array("src", "dst")).alias("name")).distinct()


def complete(nodes: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """nodes (keys..., name, type), with the edge ends they lack as EXTERNAL."""
    have = nodes.select(*keys, "name")
    return nodes.select(*keys, "name", "type").unionByName(endpoints(edges, *keys).join(have, [*keys, "name"], "left_anti").withColumn("type", F.lit(EXTERNAL)))


def external_callers(nodes: DataFrame, edges: DataFrame, whole: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Adds the whole graph's callers of all nodes: (nodes, edges), new callers being EXTERNAL."""
    callers = whole.select(F.col("src"), F.col("dst").alias("name")).join(nodes.select(*keys, "name"), "name").select(*keys, "src", F.col("name").alias("dst"))
    new = callers.distinct().join(edges.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti")
    every = edges.select(*keys, "src", "dst").unionByName(new)
    return complete(nodes, new, *keys), every


def union_first_wins(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs of files (nodes: graph, name, file; edges: graph, src, dst) as one: the first graph's file stands."""
    named = nodes.groupBy("name").agg(F.min_by("file", "graph").alias("file"))
    bare = endpoints(edges).join(named, "name", "left_anti").withColumn("file", F.lit(None).cast("string"))
    return named.unionByName(bare), edges.select("src", "dst").distinct()


def union_last_wins(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = nodes.groupBy("name").agg(F.max_by("file", "graph").alias("file"))
    bare = endpoints(edges).join(named, "name", "left_anti").withColumn("file", F.lit(None).cast("string"))
    return named.unionByName(bare), edges.select("src", "dst").distinct()


def folder_union(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (subsystem, name, file) of folders from nodes (subsystem, name, file) and edges (subsystem, file, src, dst).

    Declared nodes and edge sources are nodes, at the first file that has them; files deeper down override ones above.
    """
    sources = edges.select("subsystem", F.col("src").alias("name"), "file")
    depth = F.length("file") - F.length(F.replace(F.col("file"), F.lit("/"), F.lit("")))
    order = F.struct((-depth).alias("d"), F.col("file").alias("f"))
    return nodes.select("subsystem", "name", "file").unionByName(sources).groupBy("subsystem", "name").agg(F.min_by("file", order).alias("file"))


def contract(edges: DataFrame, dropped: DataFrame, boundary: bool, *keys: str) -> DataFrame:
    """Edges without the dropped nodes (keys..., name), each pair once.

    With a boundary, edges that lead out of or into the rest end at virtual nodes; edges between dropped nodes vanish.
    """
    gone = dropped.select(*keys, "name").distinct()
    a = gone.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col("name").alias("a_name"))
    b = gone.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("name").alias("b_name"))
    on = lambda side, end: [F.col(k) == F.col(f"{side}_{k}") for k in keys] + [F.col(end) == F.col(f"{side}_name")]
    both = edges.select(*keys, "src", "dst").distinct().join(by_key(a), on("a", "src"), "left").join(by_key(b), on("b", "dst"), "left")
    out, into = F.col("a_name").isNotNull(), F.col("b_name").isNotNull()
    if not boundary:
        return both.filter(~out & ~into).select(*keys, "src", "dst")
    src, dst = F.when(out, SOURCE).otherwise(F.col("src")), F.when(into, DESTINATION).otherwise(F.col("dst"))
    return both.filter(~(out & into)).select(*keys, src.alias("src"), dst.alias("dst")).distinct()


def simplify(nodes: DataFrame, edges: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Contracts EXTERNAL nodes, then those of types that can't be moved: (kept nodes, edges with boundary)."""
    once = contract(edges, nodes.filter(F.col("type") == EXTERNAL), True, *keys)
    twice = contract(once, nodes.filter(F.col("type").isin(*NON_MODULAR)), True, *keys)
    return nodes.filter(~F.col("type").isin(EXTERNAL, *NON_MODULAR)), twice


def without_virtual(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type") != VIRTUAL)


def filter_nodes(edges: DataFrame, nodes: DataFrame, drop: Column, boundary: bool) -> DataFrame:
    """Contraction by a predicate over node columns."""
    return contract(edges, nodes.filter(drop), boundary)


def successors_outside(edges: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct successors (name) of the base that aren't in it."""
    hop = edges.join(base.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("dst").alias("name")).distinct()
    return hop.join(base.select("name"), "name", "left_anti")
