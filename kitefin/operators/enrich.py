"""Enrichment of per-file call edges through global variables and their points-to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_global
from ..shared import by_key
from .iterate import acyclic_closure


def global_users(points_to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From points-to edges (file, src, dst): functions that globals stand for (key, value), and direct users (gv, func)."""
    e = points_to.select("src", "dst").distinct()
    from_gv, to_gv = is_global(F.col("src")), is_global(F.col("dst"))
    direct = e.filter(from_gv & ~to_gv).select(F.col("src").alias("key"), F.col("dst").alias("value"))
    return acyclic_closure(e.filter(from_gv & to_gv), direct), e.filter(~from_gv & to_gv).select(F.col("dst").alias("gv"), F.col("src").alias("func"))


def enrich(nodes: DataFrame, edges: DataFrame, points_to: DataFrame) -> DataFrame:
    """Edges (file, src, dst) with those that points-to edges of the same file imply.

    func -> gv becomes func -> every function that the global stands for; gv -> func becomes caller -> func for each
    direct user of the global that the file declares (nodes: file, name); func -> func stays; gv -> gv is dropped.
    """
    stands_for, users = global_users(points_to)
    from_gv, to_gv = is_global(F.col("src")), is_global(F.col("dst"))
    through = points_to.filter(~from_gv & to_gv).join(by_key(stands_for.withColumnRenamed("key", "dst")), "dst").select("file", "src", F.col("value").alias("dst"))
    declared = points_to.filter(from_gv & ~to_gv).join(by_key(users.withColumnRenamed("gv", "src")), "src").select("file", F.col("func").alias("src"), "dst")
    declared = declared.join(by_key(nodes.select("file", F.col("name").alias("src"))), ["file", "src"], "left_semi")
    plain = points_to.filter(~from_gv & ~to_gv).select("file", "src", "dst")
    have = edges.select("file", "src", "dst").distinct()
    # One distinct over all parts instead of an anti join for each.
    return have.unionByName(through).unionByName(declared).unionByName(plain).distinct()
