"""The pipeline's near-duplicate stage: shingles of five words, similarity 0.8."""

import random

import corpus_pipeline


def test_copies_between_the_limits_go(spark, sf_dir):
    r, rows = random.Random(5), []
    for k in range(30):
        words = [f"w{r.randrange(10**9)}" for _ in range(300)]
        copy = list(words)
        # 26 words: similarity 0.82, which 0.85 would keep; 60: under both limits.
        size = 26 if k % 2 else 60
        copy[100 : 100 + size] = [f"n{r.randrange(10**9)}" for _ in range(size)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {d.doc_id for d in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert left == {2 * k for k in range(30)} | {2 * k + 1 for k in range(0, 30, 2)}


def test_rows_without_words_all_stay(spark, sf_dir):
    """Whether or not some other row is repeated."""
    text = "one two three four five six"
    for again in (0, 1):
        rows = [(1, ""), (1, ""), (1, None), (None, " "), (None, " "), (2, text)] + [(2, text)] * again
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        left = sorted(((d.doc_id or 0, d.text or "") for d in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()))
        assert left == [(0, " "), (0, " "), (1, ""), (1, ""), (1, ""), (2, text)]
