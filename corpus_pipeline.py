"""A training corpus from `documents`: quality rules, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Decisions are joined back by row: by
doc_id, null being equal to null, and a hash of the text, so that rows of one doc_id, or of none, stand and fall by
their own texts. Stages handle what their operators handle: nulls, empty and long texts, repeated rows, empty tables,
further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitefin.llm import decontamination, jaccard_join, mixing, quality, secret_scan
from kitefin.llm._common import WORD_PATTERN, moved, shared_dir, stage, table, text_key


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that have a doc_id and a text_key of rows."""
    gone = moved(stage(rows.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (text_key() == gone["_gone_key"])
    return docs.join(gone, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a certified cutoff rejects go."""
    return _without(docs, quality.assess(docs, table(spark, sf_dir, "labels")).filter("not kept"))


#: Near duplicates: shingles of so many words, and the least Jaccard similarity in percent.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one with the least doc_id stays, and one row of those equal to it.

    Texts without words are in no component: all their rows stay.
    """
    found = stage(jaccard_join.join_documents(docs, NEAR_SHINGLE, NEAR_PERCENT)).filter("class_id is not null")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = found.groupBy(F.col("class_id").alias("f_class")).agg(F.min(row).alias("first"))
    rest = found.join(first, F.col("class_id") == F.col("f_class")).filter(~row.eqNullSafe(F.col("first")))
    kept = _without(docs, rest)
    rows, different = found.agg(F.count("*"), F.count_distinct(row)).first()
    if rows == different:
        return kept
    has_word = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    return kept.filter(has_word).dropDuplicates(["doc_id", "text"]).unionAll(kept.filter(~has_word))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _without(docs, decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; all documents stay."""
    return secret_scan.redact(docs, secret_scan.new_ledger(spark))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words it takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
]

#: Learned cutoffs, graph components and pattern scans: tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
