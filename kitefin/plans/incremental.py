"""Advice kept up to date: what a changed, new or deleted file can't have touched is not computed again.

A folder holds a manifest of the adjacency files (path, time, size), their nodes and edges in parts by a hash of the file,
and the advice by directory. A refresh compares the manifest with the files, parses what differs, and finds the functions
whose edges or declarations changed: the old and the new ones of those files. A directory's advice depends on what is
declared in it and on the edges into that, so the directories above the changed files and above the files that declare such
functions are dirty, and they alone are computed and written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import path_prefixes
from ..schema import DEFAULT_TYPE
from ..shared import checkpoint
from ..sources.graphs import adjacency
from ..sources.text_lines import read_lines
from .advise import advise, by_subsystem

#: Parts of the tables of nodes and edges; those without changed files aren't written.
PARTS = 64
#: Of more changed files than this, names aren't handed to the reader; it then reads all files and keeps those.
MOST_PATHS = 10_000
_TABLES = {"manifest": "file string, time timestamp, size long", "nodes": "file string, name string", "edges": "file string, src string, dst string"}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/{name}").drop("part")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], _TABLES[name])


def _replace(table: DataFrame, new: DataFrame, changed: DataFrame, path: str) -> None:
    """The rows of changed files (file) replaced by new ones; only the parts that hold such files are written."""
    part = F.pmod(F.xxhash64("file"), F.lit(PARTS)).cast("int")
    parts = changed.select(part.alias("part")).distinct()
    rows = table.withColumn("part", part).join(parts, "part", "left_semi").join(changed.select("file"), "file", "left_anti")
    every = checkpoint(rows.unionByName(new.withColumn("part", part)))
    every.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    _delete(table.sparkSession, [f"{path}/part={r.part}" for r in parts.join(every.select("part").distinct(), "part", "left_anti").collect()])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def refresh(spark: SparkSession, sources: str, path: str, types: DataFrame, points_to: bool = False, glob: str = "*.txt") -> DataFrame:
    """Brings the advice in `path` up to date with the adjacency files below `sources`; the directories that were computed.

    types: name, type of functions; others are of the default type. If types change, refresh into a new folder. The advice,
    `<path>/advice`, equals that of all files computed at once. A function's file is its file's path below sources without
    the extension.
    """
    root = sources.rstrip("/")
    place = F.concat(F.lit("/"), F.ltrim(F.regexp_replace(F.substring_index("file", root + "/", -1), r"\.[^./]*$", "")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    now = checkpoint(files.select(F.col("path").alias("file"), F.col("modificationTime").alias("time"), F.col("length").alias("size")))
    held = _read(spark, path, "manifest")
    old = held.select("file", F.col("time").alias("o_time"), F.col("size").alias("o_size"))
    both = now.join(old, "file", "full")
    changed = checkpoint(both.filter(~F.struct("time", "size").eqNullSafe(F.struct("o_time", "o_size"))).select("file", F.col("time").isNotNull().alias("there")))
    present = changed.filter("there").select("file")
    paths = [r.file for r in present.limit(MOST_PATHS + 1).collect()]
    none = spark.createDataFrame([], "file string, line_no int, text string")
    lines = none if not paths else read_lines(spark, paths if len(paths) <= MOST_PATHS else root, glob).join(present, "file", "left_semi")
    found, calls = adjacency(lines, points_to)
    new = {"nodes": checkpoint(found.select("file", "name").distinct()), "edges": checkpoint(calls.select("file", "src", "dst").distinct())}
    before = {k: checkpoint(_read(spark, path, k).join(changed.select("file"), "file", "left_semi")) for k in new}
    if changed.isEmpty():
        return spark.createDataFrame([], "subsystem string")
    touched = [d["nodes"].select("name") for d in (before, new)] + [d["edges"].select(F.explode(F.array("src", "dst")).alias("name")) for d in (before, new)]
    functions = touched[0].unionByName(touched[1]).unionByName(touched[2]).unionByName(touched[3]).distinct()
    for k, rows in new.items():
        _replace(_read(spark, path, k), rows, changed, f"{path}/{k}")
    nodes, edges = _read(spark, path, "nodes"), _read(spark, path, "edges")
    declaring = nodes.unionByName(before["nodes"]).join(functions, "name", "left_semi").select("file")
    dirty = checkpoint(changed.select("file").unionByName(declaring).distinct().select(F.explode(path_prefixes(place)).alias("subsystem")).distinct())
    located = nodes.select(place.alias("file"), "name").distinct()
    typed = located.join(types.select("name", "type"), "name", "left").select("name", "file", F.coalesce("type", F.lit(DEFAULT_TYPE)).alias("type"))
    in_folder, folder_edges = (df.join(dirty, "subsystem", "left_semi") for df in by_subsystem(typed, edges.select(place.alias("file"), "src", "dst")))
    advice = checkpoint(advise(in_folder, folder_edges, edges.select("src", "dst").distinct()))
    advice.repartition("subsystem").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subsystem").parquet(f"{path}/advice")
    gone = dirty.join(advice.select("subsystem").distinct(), "subsystem", "left_anti")
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    _delete(spark, [f"{path}/advice/subsystem={escape(r.subsystem)}" for r in gone.collect()])
    now.write.mode("overwrite").parquet(f"{path}/manifest")
    return dirty
