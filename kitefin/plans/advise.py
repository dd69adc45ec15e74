"""The whole middle tier: advice for every function of every directory at every depth, in shared rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import path_prefixes
from ..operators.graph import contract, external_callers
from ..operators.iterate import components, peel
from ..schema import DEFAULT_TYPE
from ..shared import by_key, checkpoint

KEPT = (DEFAULT_TYPE, "VIRTUAL_STRUCTS_REACH_TOP")


def by_subsystem(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, file, type) and file edges (file, src, dst), once for each directory above their file."""
    above = F.explode(path_prefixes(F.col("file"))).alias("subsystem")
    return nodes.select(above, "name", "file", "type"), edges.select(above, "src", "dst").distinct()


def advise(nodes: DataFrame, folder_edges: DataFrame, whole: DataFrame, key: str = "subsystem") -> DataFrame:
    """key, name, recommendation, component from nodes (key, name, type), their edges (key, src, dst) and all edges.

    Only plain functions can be moved. Entries are those that something outside the movable set calls; what no entry,
    cycle or function behind one reaches is deleted by peeling; components are of the movable functions alone.
    """
    _, edges = external_callers(nodes.select(key, "name", "type"), folder_edges, whole, key)
    kept = nodes.filter(F.col("type").isin(*KEPT)).select(key, "name").distinct()
    ends = edges.join(kept.select(key, F.col("name").alias("dst")), [key, "dst"], "left_semi")
    inside = kept.select(F.col(key).alias("k_key"), F.col("name").alias("k_name"))
    marked = checkpoint(ends.join(inside, (F.col(key) == F.col("k_key")) & (F.col("src") == F.col("k_name")), "left").select(key, "src", "dst", F.col("k_name").isNotNull().alias("inner")).distinct())
    inner = marked.filter("inner").select(key, "src", "dst")
    entries = marked.filter("not inner").select(key, F.col("dst").alias("name")).distinct()
    gone = peel(inner, kept, entries, key)
    classes = components(inner, kept, key)
    said = entries.withColumn("recommendation", F.lit("INTERFACE")).unionByName(gone.select(key, "name").withColumn("recommendation", F.lit("DELETE")))
    return classes.join(said, [key, "name"], "left").select(key, "name", F.coalesce("recommendation", F.lit("NORMAL")).alias("recommendation"), "component")


def advise_staged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, recommendation from typed nodes and edges with boundary nodes, stage by stage; the closed form's check."""
    from ..schema import DESTINATION, EXTERNAL, NON_MODULAR, SOURCE

    once = contract(edges, nodes.filter(F.col("type") == EXTERNAL), True)
    twice = checkpoint(contract(once, nodes.filter(F.col("type").isin(*NON_MODULAR)), True))
    kept = nodes.filter(F.col("type").isin(*KEPT)).select("name")
    entries = twice.filter((F.col("src") == SOURCE) & (F.col("dst") != DESTINATION)).select(F.col("dst").alias("name")).distinct()
    inner = twice.filter(~F.col("src").isin(SOURCE, DESTINATION) & ~F.col("dst").isin(SOURCE, DESTINATION))
    gone = peel(inner, kept, entries)
    said = entries.withColumn("recommendation", F.lit("INTERFACE")).unionByName(gone.withColumn("recommendation", F.lit("DELETE")))
    return kept.join(by_key(said), "name", "left").select("name", F.coalesce("recommendation", F.lit("NORMAL")).alias("recommendation"))
