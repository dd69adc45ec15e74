"""Shared plumbing of the training-data operators: inputs, staging, iteration over Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed on in groups of about this many characters, so that what one group needs stays bounded.
GROUP_CHARS = 4_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases A-Z and nothing else.
ASCII_LOWER = {ord(c): ord(c) + 32 for c in _UPPER}
#: White space as the operators' word pattern `[^\x20\x09-\x0D]+` has it; for SQL patterns of Spark.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key() -> Column:
    """Of a row's text: with doc_id it names a row where ids are null or repeated. Null texts are empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or a new one for a local master."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kitefin-")
        sc.setCheckpointDir(found)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


#: Of Spark, since 4.1: a query's shuffle files go when the query is over.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: dict[str, SparkSession] = {}


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors.

    Nothing reads the query's shuffle files again, so Spark deletes them behind it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    _staged[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found._stage_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = df._stage_path
        delete_path(_staged.pop(path), path)


def moved(table: DataFrame) -> DataFrame:
    """A table that grows with the input, to be joined by key at every size: what a small run shows, a large one does."""
    return table.hint("merge")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear_staged() -> None:
    for path, spark in _staged.items():
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def text_groups(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = GROUP_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts, each of about `chars` bytes at most or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for k, n in enumerate(sizes):
            if k > start and total + n > chars:
                part = batch.slice(start, k - start)
                yield part, part.column(column).to_pylist()
                start, total = k, 0
            total += n
        part = batch.slice(start)
        yield part, part.column(column).to_pylist()


def arrow_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=schema.field(k).type) for k, v in columns.items()], schema=schema)
