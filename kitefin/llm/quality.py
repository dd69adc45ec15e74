"""Quality rules with risk-controlled thresholds.

Each rule scores a document on a fixed grid of levels, more being worse. For each stratum (language), the levels of all
rules are put on one scale by how much of the documents at or above a level is labelled bad, counted on bad and
unlabelled documents only; a document's score is the greatest of its rules'. One cutoff of the score is chosen on the
good documents: going down from the highest score, a cutoff stays admissible as long as an exact binomial test rejects
"more than ALPHA of the good documents are above it" at DELTA / strata; the test stops at the first score that fails (a
fixed sequence needs no further correction, as no good document took part in making it, and the division is
Bonferroni's over strata). So with probability 1 - DELTA, no stratum loses more than ALPHA of its good documents. Among
admissible cutoffs the one with the best balance of bad and good documents above it is taken, and given back as one
level for each rule; a stratum without one (four strata: fewer than some 440 good labels) rejects nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage, text_groups, text_key

RULES = ("repeats", "duplicate_lines", "symbols", "capitals", "exclamations", "word_length")
LEVELS = 200
ALPHA, DELTA = 0.01, 0.05
#: A good document above a cutoff weighs as much as so many bad ones.
GOOD_WEIGHT = 20
LEAST_WORDS, MOST_REPEATS = 50, 50
#: Added to the documents above a level, so that few make no high share.
FEW = 10

_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(0x41, 0x5B))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that are in the text twice or more, the first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
    again = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[list[int], list[int]]:
    """The counts of a whole text, and its level under each rule."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    without = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, chars, symbols = len(words), len(text) - without(_SPACES), without(_SYMBOLS)
    duplicates, repeats = len(lines) - len(set(lines)), repeated_words(words)
    shares = (repeats / max(n, 1), duplicates / max(len(lines), 1), symbols / max(n, 1), without(_CAPITALS) / max(chars, 1), without(b"!?") / max(2 * n, 1), chars / max(40 * n, 1))
    return [n, chars, symbols, duplicates, repeats], [min(LEVELS, math.floor(LEVELS * s)) for s in shares]


def _measures(batches):
    for batch, texts in text_groups(batches):
        both = [measure(t or "") for t in texts]
        counts = [pa.array([c[k] for c, _ in both], pa.int64()) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("stratum"), *counts, pa.array([x for _, x in both], pa.list_(pa.int32()))], names=["doc_id", "text_key", "stratum", *COUNTS, "levels"])


def tail_at_most(k: np.ndarray, n: int, p: float) -> np.ndarray:
    """P(Bin(n, p) <= k), exactly up to rounding, for each of k."""
    top = int(k.max(initial=-1))
    terms = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(min(top, n) + 1)])
    total = np.exp(np.logaddexp.accumulate(terms)) if len(terms) else np.zeros(0)
    return np.where(k >= n, 1.0, total[np.minimum(k, n).astype(int)]) if len(terms) else np.ones(len(k))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int:
    """The cutoff for one rule from the number of good and bad documents at each level; LEVELS means none.

    A document is rejected when its level is above the cutoff.
    """
    n = int(good.sum())
    above_good, above_bad = (np.r_[np.cumsum(x[::-1])[::-1][1:], 0] for x in (good, bad))
    if not n:
        return LEVELS
    # More false rejections than the bound allows on average can't pass; the tail is only summed up to there.
    most = int(alpha * n)
    passed = np.array([False] * (LEVELS + 1))
    within = above_good <= most
    passed[within] = tail_at_most(above_good[within], n, alpha) <= delta
    first_failing = np.flatnonzero(~passed)
    low = int(first_failing[-1]) + 1 if len(first_failing) else 0
    worth = above_bad[low:] - GOOD_WEIGHT * above_good[low:]
    if low > LEVELS or worth.max() <= 0:
        return LEVELS
    return low + int(np.flatnonzero(worth == worth.max())[-1])


def scale(bad: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """A rule's levels as scores from 0 to LEVELS: the share of bad ones among bad and unlabelled ones at or above.

    Scores never fall with the level. Where nothing is unlabelled, levels are scores.
    """
    if not unknown.sum():
        return np.arange(LEVELS + 1)
    above_bad, above = (np.cumsum(x[::-1])[::-1] for x in (bad, bad + unknown))
    return np.maximum.accumulate(LEVELS * above_bad // (above + FEW))


def _tables(rows: pd.DataFrame) -> pd.DataFrame:
    known, scores = rows["good"].notna(), []
    for rule in range(len(RULES)):
        count = lambda at: np.bincount(rows["level"][at], rows["n"][at], LEVELS + 1).astype(np.int64)
        scores.append(scale(count((rows["rule"] == rule) & known), count((rows["rule"] == rule) & ~known)).tolist())
    return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "scores": [scores]})


def cutoffs(levels: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs (one for each rule) from all labelled documents that the base keeps.

    Counts by stratum, rule and level, and by stratum and score, are summed by Spark; a stratum's choice sees no more.
    A document labelled more than once counts as good if any label says so; labels that are null are ignored.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(F.max("quality").alias("quality"))
    held = levels.filter("not base_failed").join(known, F.col("doc_id") == F.col("l_doc"), "left").select("stratum", (F.col("quality") > 0).alias("good"), "levels")
    held = stage(held)
    others = held.filter("good is null or not good").select("stratum", "good", F.posexplode("levels").alias("rule", "level"))
    tables = others.groupBy("stratum", "good", "rule", "level").agg(F.count("*").alias("n")).groupBy("stratum").applyInPandas(_tables, "stratum string, scores array<array<int>>")
    tables = stage(tables)
    scored = held.filter("good is not null").join(tables, "stratum").select("stratum", "good", F.expr("array_max(transform(levels, (l, r) -> scores[r][l]))").alias("score"))
    counts = stage(scored.groupBy("stratum", "good", "score").agg(F.count("*").alias("n")))
    # Strata without bad documents choose no cutoff, but are among those that could.
    strata = held.filter("good is not null").select("stratum").distinct().count()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        count = lambda good: np.bincount(rows["score"][rows["good"] == good], rows["n"][rows["good"] == good], LEVELS + 1).astype(np.int64)
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "cutoff": [choose_cutoff(count(True), count(False), alpha, delta / max(strata, 1))]})

    chosen = counts.groupBy("stratum").applyInPandas(choose, "stratum string, cutoff int")
    last = F.expr("transform(scores, s -> size(filter(s, x -> x <= cutoff)) - 1)").cast("array<int>")
    return chosen.join(tables, "stratum").select("stratum", last.alias("cutoffs"))


def assess(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each row of documents: doc_id, text_key, stratum, counts, levels, base_failed, rejected_by, kept.

    The stratum is lang (null: a stratum of its own, the empty string). Null texts have no words and fail the base;
    repeated rows each give a row; empty labels or an empty table mean no cutoffs. Whole texts are measured; columns
    besides doc_id, text and lang are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), "text")
    measured = rows.mapInArrow(_measures, "doc_id long, text_key long, stratum string, " + "".join(f"{c} long, " for c in COUNTS) + "levels array<int>")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    levels = stage(measured.withColumn("base_failed", failed))
    chosen = cutoffs(levels, labels, alpha, delta).select(F.col("stratum").alias("c_stratum"), "cutoffs")
    joined = levels.join(chosen, levels.stratum == F.col("c_stratum"), "left")
    names = F.array(*map(F.lit, RULES))
    above = F.expr("coalesce(filter(sequence(0, size(levels) - 1), i -> levels[i] > cutoffs[i]), array())").cast("array<int>")
    joined = joined.withColumn("above", F.when(F.col("cutoffs").isNull(), F.array().cast("array<int>")).otherwise(above))
    rejected = F.transform("above", lambda i: names[i])
    return joined.select("doc_id", "text_key", "stratum", *COUNTS, "levels", "base_failed", rejected.alias("rejected_by"), (~F.col("base_failed") & (F.size("above") == 0)).alias("kept"))
