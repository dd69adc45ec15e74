"""The Jaccard join against all pairs of small tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kitefin.llm import jaccard_join, queries
from kitefin.llm._common import ASCII_LOWER

from .test_row_operators import documents, odd_documents, rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    n = min(4, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    found = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            found[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    common = defaultdict(int)
    for members in found.values():
        for k, a in enumerate(members):
            for b in members[:k]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df):
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_documents(df).collect()}
    assert got == want
    return want


def test_join_query(spark, sf_dir):
    want = brute([(d.doc_id, d.text) for d in documents(spark, sf_dir)])
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in rows(queries.op7_jaccard_join(spark, sf_dir)).items()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def family(r, n, words, most):
    """Copies of one text, each with some words changed; changes of copies of copies add up."""
    made = [r.choices(words, k=r.randrange(8, 200))]
    for _ in range(n):
        copy = list(r.choice(made[:3] + made[-1:]))
        for _ in range(r.randrange(most)):
            k = r.randrange(len(copy) + 1)
            copy[k : k + r.randrange(2)] = r.choices(words, k=r.randrange(2))
        made.append(copy)
    return [" ".join(x) for x in made]


def test_pivots_find_the_links(spark, monkeypatch):
    """On the given tables: sets are measured against pivots of cells, and most links come from there."""
    found = {}
    cells = jaccard_join._cells

    def seen(*args):
        out = cells(*args)
        found["cells"], found["links"] = (x.count() for x in out)
        return out

    monkeypatch.setattr(jaccard_join, "_cells", seen)
    measure, pairs = jaccard_join._measure, []
    monkeypatch.setattr(jaccard_join, "_measure", lambda p, sets: pairs.append(p.count()) or measure(p, sets))
    df = jaccard_join.join_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    linked = df.filter("doc_id <> component_id").count()
    assert found["cells"] > found["links"] > 0 and linked > 0 and pairs[0] >= found["links"]


@pytest.mark.parametrize("seed, rounds, sample", [(1, 3, 16_000), (2, 1, 1)])
def test_join_families(spark, monkeypatch, seed, rounds, sample):
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "SAMPLE_HITS", 8 if sample > 1 else 1_000_000)
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgé", k=5)) for _ in range(400)]
    passage = " ".join(r.choices(words, k=30))
    texts = [t for _ in range(6) for t in family(r, r.randrange(40), words, 6)]
    texts += [" ".join([passage, *r.choices(words, k=r.randrange(60))]) for _ in range(60)]
    texts += [" ".join(words[a : a + 40]) for a in range(0, 40)] + ["", None, "a b c", "A b c", "a b", "a  b\n", "\x1c"]
    r.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))


def test_join_odd_rows(spark):
    odd = odd_documents(spark)
    got = jaccard_join.join_documents(odd.withColumn("component_id", F.lit("x"))).collect()
    assert len(got) == 8 and sum(r.n_shingles == 0 for r in got) == 3
    assert jaccard_join.join_documents(odd.limit(0)).count() == 0
    text = " ".join(map(str, range(60)))
    made = [(5, text), (5, "other words of its own"), (4, text + " x"), (None, text), (9, "other words of its own")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.join_documents(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {(5, 57): 4, (5, 2): 5, (4, 58): 4, (None, 57): 4, (9, 2): 5}


def test_rows_without_ids_are_joined_by_their_texts(spark):
    """As many rows of one doc_id, or of none, as of many: each is looked up by its own key."""
    r = random.Random(9)
    texts = [" ".join(r.choices("abcdefghij", k=30)) for _ in range(1000)]
    texts += [t + " k" for t in texts]
    made = [(None if k % 2 else 5, t) for k, t in enumerate(texts)] + [(5, texts[0])] * 20
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    found = jaccard_join.join_documents(df)
    got = found.groupBy("class_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c"), F.count_distinct("text_key").alias("texts")).collect()
    assert len(got) == 1000 and sorted(x.n for x in got) == [2] * 999 + [22] and all(x.texts == 2 for x in got)
    seen, keep = [], jaccard_join.stage

    def count(df, *partition_by):
        out = keep(df, *partition_by)
        if "shingles" in out.columns:
            seen.append(out.count())
        return out

    jaccard_join.stage = count
    try:
        jaccard_join.join_documents(df.limit(500)).count()
    finally:
        jaccard_join.stage = keep
    assert seen and max(seen) <= 500


def test_regions_meet():
    """Linked sets share a region, whatever counts as common."""
    r = random.Random(6)
    for _ in range(3000):
        n = r.choice([r.randrange(5, 40), r.randrange(5, 600)])
        pool = np.array([r.getrandbits(64) for _ in range(n + 200)], np.uint64)
        a, rest = set(pool[:n].tolist()), pool[n:].tolist()
        d = r.randrange(int(0.18 * n) + 2)
        gone = set(r.sample(sorted(a), r.randrange(min(d, n - 1) + 1)))
        b = (a - gone) | set(rest[: max(0, min(200, d - len(gone)))])
        if 100 * len(a & b) < 85 * len(a | b) or a == b:
            continue
        common = np.array(sorted(r.sample(sorted(a | b), r.choice([0, 0, len(a) // 2, len(a | b)]))), np.uint64)
        x, y = (jaccard_join.regions(np.array(sorted(s), np.uint64), common) for s in (a, b))
        assert set(x.tolist()) & set(y.tolist()), (len(a), len(b), len(a & b))


@pytest.mark.parametrize("small", [0, 20_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL_EDGES", small)
    r = random.Random(7)
    for n, m in ((40, 40), (50, 12)):
        edges = [(k, k + 1) for k in range(m)] if n == 50 else [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        got = {x.node: x.component for x in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        root = {k: k for e in edges for k in e}
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
