"""Vector codes against plain Lloyd rounds over Python integers."""

import math

import numpy as np
import pytest

from kitefin.llm import vector_codes as V

SCHEMA = "label int, vec_id long, kind string, embedding array<float>, code string, sums int"


def plain(rows, parts, entries, rounds):
    """rows: (vec_id, label, vector). Rows of (vec_id, codes, error, label_error), codebooks."""
    rows = [(i, l, [math.floor(1024 * x) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2]) // parts
    cut = [[tuple(v[k * width : (k + 1) * width]) for k in range(parts)] for _, _, v in rows]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for r in range(rounds + 1):
        found = [[nearest(c[k], books[k]) for k in range(parts)] for c in cut]
        if r < rounds:
            for k in range(parts):
                for e in range(len(books[k])):
                    own = [c[k] for c, f in zip(cut, found) if f[k][1] == e]
                    if own:
                        books[k][e] = [sum(x) // len(own) for x in zip(*own)]
    errors = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for (_, label, _), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, [e for _, e in f], err, by_label[label]) for (i, label, _), f, err in zip(rows, found, errors)), key=repr), books


def run(spark, rows, **kw):
    df = spark.createDataFrame([(label, i, "x", v, "y", 7) for i, label, v in rows], SCHEMA).repartition(3)
    codes, books = V.compress(df, **kw)
    return sorted(((r.vec_id, list(r.code), r.error, r.label_error) for r in codes.collect()), key=repr), [b.tolist() for b in books]


def test_against_plain_rounds_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-3, 4, (6, 8))
    rows = [(int(i), None if i % 5 == 0 else int(i % 3), [float(x) / 64 for x in centres[i % 6] + rng.integers(-1, 2, 8)]) for i in range(160)]
    rows += rows[:9] + [(None, 1, rows[3][2]), (None, None, rows[4][2]), (7, 2, rows[5][2])]
    rows += [(900, 1, None), (901, 1, [1.0] * 7 + [None]), (902, None, [float("nan")] + [0.5] * 7), (903, 1, [float("inf")] * 8), (904, 1, [float("-inf")] + [0.0] * 7)]
    got, books = run(spark, rows, parts=4, entries=16, rounds=4)
    want, want_books = plain(rows, 4, 16, 4)
    assert books == want_books
    assert got == want


def test_fewer_vectors_than_entries_and_one_vector(spark):
    rows = [(3, 1, [0.1, -0.2, 0.3, 0.4]), (1, None, [0.1, -0.2, 0.9, 0.4])]
    for some in (rows, rows[:1]):
        assert run(spark, some, parts=2, entries=256, rounds=3) == plain(some, 2, 256, 3)


def test_bounds_spare_measuring(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, [float(x) for x in np.repeat(i % 4, 4) + rng.normal(0, 0.01, 4)]) for i in range(400)]
    df = spark.createDataFrame([(label, i, "", v, "", 0) for i, label, v in rows], SCHEMA)
    codes, _ = V.compress(df, parts=2, entries=4, rounds=4)
    scans = [r.n_scans for r in codes.collect()]
    assert min(scans) >= 2 and sum(scans) < 3 * len(scans)  # of 10 a vector
    assert run(spark, rows, parts=2, entries=4, rounds=4) == plain(rows, 2, 4, 4)


def test_large_components_are_measured_as_integers():
    rng = np.random.default_rng(2)
    x, c = (rng.integers(-(1 << 27), 1 << 27, (20, 4)) for _ in range(2))
    assert V.squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]


def test_empty_table_and_bad_shapes(spark):
    codes, books = V.compress(spark.createDataFrame([], SCHEMA))
    assert codes.count() == 0 and all(len(b) == 0 for b in books)
    assert V.digest(codes, books).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        run(spark, [(1, 1, [0.5] * 6)], parts=4)
    with pytest.raises(ValueError):
        run(spark, [(1, 1, [0.5] * 4), (2, 1, [0.5] * 8)])
    with pytest.raises(ValueError):
        run(spark, [(1, 1, [3e38] * 4)])
