"""Certified cutoffs of quality rules on few labels."""

import math

import numpy as np
from pyspark.sql import functions as F

from kitefin.llm import quality


def test_a_stratum_of_480_good_labels_rejects(spark):
    rows = [(k, "xx", False, [k % 20, 0, 0 if k % 10 else 90 + k % 50, 2, 0, 24]) for k in range(1600)]
    levels = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, levels array<int>")
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(534)], "doc_id long, quality int")
    (chosen,) = quality.cutoffs(levels, labels).collect()
    above = lambda v: any(x > c for x, c in zip(v, chosen.cutoffs))
    assert {r[0] for r in rows if above(r[3])} == {k for k in range(1600) if k % 10 == 0}
    few = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(300)], "doc_id long, quality int")
    (chosen,) = quality.cutoffs(levels, few).collect()
    assert not any(above(r[3]) for r in rows)


def test_scale():
    bad, unknown = np.zeros(201, int), np.zeros(201, int)
    assert quality.scale(bad, unknown).tolist() == list(range(201))
    bad[100], unknown[0], unknown[100] = 50, 900, 40
    assert quality.scale(bad, unknown).tolist() == [10] + [100] * 200


def brute_scores(rows):
    """Of one stratum's rows (label or None, levels): each row's score by the rules' shares of bad ones."""
    open_ = [(x, v) for x, v in rows if x != 1]
    tables = []
    for rule in range(len(quality.RULES)):
        held, table = 0, []
        for level in range(quality.LEVELS + 1):
            bad = sum(1 for x, v in open_ if x == 0 and v[rule] >= level)
            every = sum(1 for x, v in open_ if v[rule] >= level)
            held = max(held, quality.LEVELS * bad // (every + quality.FEW))
            table.append(held if any(x is None for x, _ in open_) else level)
        tables.append(table)
    return [max(t[level] for t, level in zip(tables, v)) for _, v in rows]


def brute_cutoff(good, bad, strata):
    """Going down from the top as long as the exact tail allows; the best balance of what was passed."""
    n, best = len(good), (0, None)
    for cutoff in range(quality.LEVELS, -1, -1):
        lost = sum(s > cutoff for s in good)
        tail = sum(math.comb(n, k) * quality.ALPHA**k * (1 - quality.ALPHA) ** (n - k) for k in range(lost + 1))
        if not n or tail > quality.DELTA / strata:
            break
        worth = sum(s > cutoff for s in bad) - quality.GOOD_WEIGHT * lost
        best = max(best, (worth, cutoff), key=lambda x: x[0])
    return best[1]


def brute_kept(levels, label):
    """ids that stay, from rows (doc_id, stratum, base_failed, levels)."""
    kept, strata = set(), {r.stratum for r in levels if not r.base_failed and r.doc_id in label}
    for stratum in {r.stratum for r in levels}:
        own = [r for r in levels if r.stratum == stratum and not r.base_failed]
        scores = brute_scores([(label.get(r.doc_id), r.levels) for r in own])
        by = lambda x: [s for s, r in zip(scores, own) if label.get(r.doc_id) == x]  # noqa: E731, B023
        cutoff = brute_cutoff(by(1), by(0), len(strata))
        kept |= {r.doc_id for s, r in zip(scores, own) if cutoff is None or s <= cutoff}
    return kept


def test_verdicts_on_the_tables(spark):
    """Cutoffs reject on sf0.1, as a recomputation by brute force does; on labels held out they keep the bound."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = quality.assess(docs, labels).collect()
    label = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in found if r.kept}
    assert kept == brute_kept(found, label)
    rejected = [r.doc_id for r in found if not r.base_failed and not r.kept]
    assert sum(label.get(k) == 0 for k in rejected) > 200
    for part in (0, 1):
        half = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part)
        fitted = {r.doc_id for r in half.collect()}
        out = [r for r in quality.assess(docs, half).collect() if not r.base_failed and r.doc_id in label and r.doc_id not in fitted]
        for stratum in {r.stratum for r in out}:
            good = [r.kept for r in out if r.stratum == stratum and label[r.doc_id] == 1]
            assert good.count(False) <= 2 * quality.ALPHA * len(good) + 3, stratum
