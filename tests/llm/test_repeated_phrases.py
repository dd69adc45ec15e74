"""Repeated phrases against a dictionary of windows."""

import numpy as np
import pytest

from kitefin.llm import repeated_phrases as R

SCHEMA = "pack string, doc_id long, text string, words int, kept string"


def plain(rows, window):
    order = lambda i: (i is not None, i or 0)
    first: dict = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < order(i):
                gone |= set(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=repr)


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([("x", i, t, 1, "y") for i, t in rows], SCHEMA).repartition(parts)
    found = R.dedup_phrases(df, **kw).collect()
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr)


def texts(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" if k % 9 else f"wört{k}" for k in range(vocabulary)])
    passages = [" ".join(words[rng.integers(0, vocabulary, int(m))]) for m in rng.integers(2, 60, 12)]
    out = []
    for _ in range(n):
        parts = [" ".join(words[rng.integers(0, vocabulary, int(rng.integers(0, 20)))]) if rng.random() < 0.6 else passages[int(rng.integers(0, 12))] for _ in range(int(rng.integers(0, 6)))]
        out.append(["  ", "\n", "\t", " "][int(rng.integers(0, 4))].join(parts))
    return out


@pytest.mark.parametrize("key_bits", [32, 3])
def test_against_all_windows(spark, monkeypatch, key_bits):
    """With keys of few bits most windows share theirs, and are told apart by their words."""
    monkeypatch.setattr(R, "PACK_BYTES", 700)
    rows = list(enumerate(texts(160, 1)))
    rows += rows[:5] + [(3, rows[9][1]), (None, rows[2][1]), (None, rows[30][1]), (None, None), (500, None), (501, ""), (502, " \n\t "), (503, "a b c"), (-8, rows[50][1]), (1 << 62, rows[51][1])]
    got = run(spark, rows, window=5, key_bits=key_bits)
    want = plain(rows, 5)
    assert got == want and sum(r[2] for r in want) > 500


def test_hot_home_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(R, "PLACE_BYTES", 300)
    text = " ".join(f"v{k}" for k in range(40))
    rows = [(i, f"{i} {text} {i}" if i % 2 else text) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(texts(20, 2))]
    assert run(spark, rows) == plain(rows, R.WINDOW)


def test_repeats_within_a_document_stay(spark):
    text = " ".join(f"v{k}" for k in range(20))
    assert run(spark, [(1, f"{text} {text} {text}")]) == [(1, 60, 0, f"{text} {text} {text}")]
    rows = [(2, f"{text} {text} {text}"), (2, text), (1, "x " + text)]
    assert run(spark, rows) == plain(rows, R.WINDOW)


def test_long_text_and_one_word(spark):
    word = "same " * 30_000
    rows = [(1, word), (2, word + "end"), (3, "x" * 300_000)]
    assert run(spark, rows) == plain(rows, R.WINDOW)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == [(None, 0, 0, "")]


def test_automata_begin_anew_when_characters_run_out(monkeypatch):
    monkeypatch.setattr(R, "MOST_WORDS", 50)
    automata = R.Automata(3)
    phrases = [[f"p{n}_{k}".encode() for k in range(9)] for n in range(20)]
    for home, p in enumerate(phrases):
        automata.add(b" ".join(p), home)
    automata.compile()
    assert len(automata.all) > 3
    for home, p in enumerate(phrases):
        assert automata.find([b"no", *p, b"no"]) == {k + 1: home for k in range(7)}
