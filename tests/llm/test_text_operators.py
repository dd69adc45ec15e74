"""Licenses, substrings and personal data, against plain Python."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kitefin.llm import license_scan, pii, queries, secret_scan, substring_dedup
from kitefin.llm.suffix_array import suffix_arrays

from .test_row_operators import SHA, documents, odd_documents, rows

# 3


def test_suffix_arrays():
    r = random.Random(3)
    for _ in range(100):
        strings = [bytes(r.choices(range(1, r.choice([2, 3, 9])), k=r.randrange(40))) + b"\0" for _ in range(r.randrange(1, 12))]
        base = np.r_[0, np.cumsum(list(map(len, strings)))]
        order = suffix_arrays(np.frombuffer(b"".join(strings), np.uint8).astype(np.int16), base)
        for k, s in enumerate(strings):
            assert (order[base[k] : base[k + 1]] - base[k]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_substrings(docs, length):
    """docs: (order key, text) in order; equal keys are one place."""
    first, out = {}, []
    for key, text in docs:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], (key, k))
    for key, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] != (key, k):
                gone[k : k + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(data), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def test_substring_query(spark, sf_dir):
    docs = sorted(documents(spark, sf_dir), key=lambda d: d.doc_id)
    want = brute_substrings([(d.doc_id, d.text) for d in docs], 100)
    got = rows(queries.op3_substring_dedup(spark, sf_dir))
    assert [tuple(got[d.doc_id].values())[1:] for d in docs] == want and any(w[1] for w in want)


@pytest.mark.parametrize("group_segments", [48, 2, 0])
def test_substring_groups(spark, group_segments):
    r = random.Random(8)
    words = ["".join(r.choices("abcé", k=r.randrange(2, 9))) for _ in range(12)]
    parts = [" ".join(r.choices(words, k=6)) for _ in range(10)]
    texts = ["".join(r.choices([*parts, "x" * 30, "ab" * 20, "q"], k=r.randrange(12))) for _ in range(60)] + [None, "", "short", "z" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = rows(substring_dedup.dedup_substrings(df, 24, group_segments))
    assert [tuple(got[k].values())[1:] for k in range(len(texts))] == brute_substrings(list(enumerate(texts)), 24)


def test_substring_pieces(monkeypatch):
    r = random.Random(2)
    data = bytes(r.choices(b"ab", k=5000))
    whole = [np.concatenate([np.arange(a, b + 1) for _, a, b, _ in zip(*substring_dedup.anchors(data))])]
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    pieces = np.concatenate([np.arange(a, b + 1) for _, a, b, _ in zip(*substring_dedup.anchors(data))])
    assert whole[0].tolist() == pieces.tolist() == list(range(5000 - 99))


def test_substring_odd_rows(spark):
    long = "one string of more than a hundred bytes, " * 3
    made = [(2, long), (None, long), (1, "x" + long), (1, long), (1, long), (3, None)]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("doc", "tie", "ranges", "start")})
    got = sorted(substring_dedup.dedup_substrings(df).collect(), key=str)
    assert len(got) == 6 and sum(r.n_removed == 0 for r in got) == 2  # the null id's and the empty one
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 2
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0
    assert substring_dedup.dedup_substrings(odd_documents(spark)).count() == 8


# 2


def test_licenses(spark, sf_dir):
    got = rows(queries.op2_license_scan(spark, sf_dir))
    docs = documents(spark, sf_dir)
    assert len(got) == len(docs)
    for d in docs:
        said = {n for n, t in license_scan.TEMPLATES.items() if n.endswith("line") and t in d.text}
        assert said == {n for n in got[d.doc_id]["licenses"].split(",") if n.endswith("line")}
    assert license_scan.scan_licenses(odd_documents(spark)).filter("size(matches) > 0").count() == 0
    assert license_scan.scan_licenses(odd_documents(spark).limit(0)).count() == 0


def test_license_alignment():
    index = license_scan.Index(license_scan.TEMPLATES)
    notice = license_scan.TEMPLATES["mit-notice"]
    changed = notice.replace("merge, publish", "MERGE -- kindly -- publish").replace("distribute, ", "")
    text = "é before. " + changed + " after"
    (m,) = index.matches(text)
    assert m["license"] == "mit-notice" and 0.95 < m["coverage"] < 1
    assert text[m["spans"][0]["start"] : m["spans"][0]["end"]] == changed.rstrip(".")
    half = " ".join(notice.split()[:30])
    assert index.matches(half) == [] and index.matches("") == []
    twice = "Released under the MIT License. x " * 2
    assert len(index.matches(twice)[0]["spans"]) == 2
    r = random.Random(1)
    for name, t in license_scan.TEMPLATES.items():
        words = t.split()
        if len(words) > 20:
            k = r.randrange(5, len(words) - 5)
            assert [x["license"] for x in index.matches(" ".join(words[:k] + ["new", "words"] + words[k + 1 :]))] == [name]


def brute_region(template, words):
    """(score, matched, first, last) of the best alignment anywhere, by all places of both."""
    best, row = (0,), [None] * (len(words) + 1)
    for t in template:
        new = [None] * (len(words) + 1)
        for j in range(1, len(words) + 1):
            ways = [row[j]] if row[j] else []
            if new[j - 1]:
                ways.append((new[j - 1][0] - 1, *new[j - 1][1:]))
            if t == words[j - 1]:
                s, n, first, _ = row[j - 1] if row[j - 1] and row[j - 1][0] > 0 else (0, 0, j - 1, 0)
                ways.append((s + 2, n + 1, first, j - 1))
            new[j] = max(ways, key=lambda x: (x[0], x[2]), default=None)
            if new[j] and new[j][0] > best[0]:
                best = new[j]
        row = new
    return best


def test_license_alignment_is_the_best():
    """Spans and coverage of altered, adjacent and repeated notices against alignments by all places."""
    r = random.Random(5)
    notices = {n: t for n, t in license_scan.TEMPLATES.items() if n in ("mit-notice", "mpl-2.0-notice", "gpl-3.0-line", "cc-by-nc-4.0-line", "mit-line")}
    index = license_scan.Index(notices)
    for _ in range(40):
        words, planted = [], []
        for _ in range(r.randrange(1, 5)):
            words += [f"z{r.randrange(10**6)}" for _ in range(r.choice([0, 0, 1, 5, 9, 30]))]
            name = r.choice(sorted(notices))
            own = license_scan._WORD.findall(notices[name])
            for _ in range(len(own) // 12):
                k = r.randrange(1, len(own) - 1)
                own[k : k + r.randrange(2)] = [f"İ{r.randrange(10**6)}"] * r.randrange(1, 3)
            words += own
            planted.append(name)
        text = " ".join(words)
        got = {m["license"]: m for m in index.matches(text)}
        low, spans = license_scan.words_of(text), [m.span() for m in re.finditer(r"[^\W_]+", text)]
        want, left = defaultdict(list), [(0, len(low))]
        while left:
            a, b = left.pop()
            found = max(((*brute_region(license_scan.words_of(t), low[a:b]), n) for n, t in notices.items()), key=lambda x: x[0])
            if found[0] >= 6:
                _, n, first, last, name = found
                if n >= 0.8 * len(license_scan.words_of(notices[name])):
                    want[name].append((a + first, a + last, n / len(license_scan.words_of(notices[name]))))
                left += [(a, a + first), (a + last + 1, b)]
        assert {n: [(s["start"], s["end"]) for s in m["spans"]] for n, m in got.items()} == {n: [(spans[a][0], spans[b][1]) for a, b, _ in sorted(x)] for n, x in want.items()}, text
        assert sorted(planted) == sorted(n for n, m in got.items() for _ in m["spans"])
        for n, m in got.items():
            if len(want[n]) == 1:
                assert m["coverage"] == pytest.approx(want[n][0][2]), text


def test_license_words_stay_in_place():
    index = license_scan.Index(license_scan.TEMPLATES | {"two": "Beerware licence", "none": "--"})
    text = "\u0130\u0130\u0130 abc. Licensed under the Apache License, Version 2.0. e"
    (m,) = index.matches(text)
    assert [text[s["start"] : s["end"]] for s in m["spans"]] == ["Licensed under the Apache License, Version 2.0"]
    assert [m["license"] for m in index.matches("a beerware\n LICENCE.")] == ["two"]
    text = "Licensed under CC BY 4.0. " * 2000 + "x " * 200_000
    began = time.time()
    assert len(index.matches(text)[0]["spans"]) == 2000 and time.time() - began < 5


# 9

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def passes(kind, s):
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            d = [int(c) for c in digits(s)][::-1]
            return 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0
        return kind == "email" or 10 <= len(digits(s)) <= 15

    out = [(k, *m.span()) for k, p in PII.items() for m in re.finditer(p, text) if passes(k, m[0])]
    return sorted(out, key=lambda x: (x[1], list(PII).index(x[0])))


def test_pii(spark, sf_dir):
    got = rows(queries.op9_personal_data(spark, sf_dir))
    docs = documents(spark, sf_dir)
    assert len(got) == len(docs)
    for d in docs:
        want, r = brute_pii(d.text or ""), got[d.doc_id]
        assert [r[f"n_{k}"] for k in PII] == [sum(x[0] == k for x in want) for k in PII]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == SHA(listed) and set(listed.split(",")) <= set(r["spans"].split(",")) | {""}
        if not re.search("[0-9@]", d.text or ""):
            assert r["spans"] == ""
    odd = pii.find_pii(odd_documents(spark))
    assert odd.count() == 8 and pii.find_pii(odd_documents(spark).limit(0)).count() == 0


def test_pii_base():
    r = random.Random(4)
    pieces = ["a.b@c.de", "@", "é", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.0004", " ", ".", "-", "x@y", "..", "+", "12", "%+@a-b.c-d.", "0" * 14, "\n"]
    for _ in range(500):
        text = "".join(r.choices(pieces, k=r.randrange(9)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_pii_model():
    crf = pii.model()
    hits = wrong = missed = 0
    for tokens, truth in pii.training_windows(300, seed=77):
        found = {x[:3] for x in crf.decode(tokens) if x[3] >= pii.MARGIN}
        hits, wrong, missed = hits + len(found & set(truth)), wrong + len(found - set(truth)), missed + len(set(truth) - found)
    assert hits / (hits + wrong) > 0.97 and hits / (hits + missed) > 0.95
    found = pii.find_personal_data("call me: phone (212) 555-0187 today", crf)
    assert [(k, b) for k, _, _, b in found] == [("phone", False)]
    assert pii.find_personal_data("version 2.0 of 2021-03-04, 17 pages", crf) == []
    # The decoder's best is the best of all segmentations.
    tokens = pii._TOKEN.findall("mail a@b.co +1 23")
    best = {0: 0.0}
    score = defaultdict(float)
    for a, b in pii.segments(tokens):
        total = sum((crf.weights[f] for f in pii.span_features(tokens, a, b) if f in crf.weights), np.zeros(len(pii.KINDS)))
        score[a, b] = float(total.max())
    for b in range(1, len(tokens) + 1):
        best[b] = max([best[b - 1], *(best[a] + s for (a, e), s in score.items() if e == b)])
    assert sum(x[3] for x in crf.decode(tokens)) == pytest.approx(best[len(tokens)])


def test_long_texts_take_linear_time():
    """A million characters that patterns used to go over again and again."""
    crf = pii.model()
    for text in ("1" * 1_000_000 + ".", "a" * 1_000_000 + "@", "1." * 500_000, "eyJ" * 330_000, "+1 " + " " * 1_000_000, "token" + " " * 1_000_000, "-----BEGIN A " * 80_000, "AKIA" * 250_000):
        began = time.time()
        secret_scan.find_secrets(text)
        pii.base_spans(text)
        assert time.time() - began < 2, text[:20]
    began = time.time()
    assert pii.find_personal_data("1" * 1_000_000 + "." + " a@" * 30_000, crf) == [] and time.time() - began < 10
    # Windows of any length are decoded whole: phones that the base doesn't match, in a table of one window.
    line = "row 17 (212) 555-1017\n"
    found = pii.find_personal_data(line * 3000, crf)
    assert [x[:3] for x in found] == [("phone", k * len(line) + 7, (k + 1) * len(line) - 1) for k in range(3000)]


def test_web_tokens():
    pattern = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
    r = random.Random(8)
    for _ in range(2000):
        text = "".join(r.choices(["eyJ", "eyJabcdefgh", "x" * 16, ".", ".", " ", "y", "_-"], k=r.randrange(12)))
        assert secret_scan._bearers(text) == [m.span() for m in pattern.finditer(text)], text


def test_phones_of_other_forms():
    crf = pii.model()
    for text, number in (("call 212.555.0187 now", "212.555.0187"), ("ring 020 7946 0018 today", "020 7946 0018")):
        assert [(k, text[a:b]) for k, a, b, _ in pii.find_personal_data(text, crf)] == [("phone", number)]


def test_whole_license_texts():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name in ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0", "mit", "mpl-2.0", "unlicense"):
        text = license_scan.TEMPLATES[name]
        (m,) = index.matches("Some words before.\n\n" + text.replace("  ", "\n * ") + "\nand behind.")
        assert m["license"] == name and m["coverage"] > 0.99, name
    for name in ("agpl-3.0-notice", "gpl-2.0-notice", "lgpl-2.1-notice", "lgpl-3.0-notice", "mpl-2.0-notice"):
        assert [m["license"] for m in index.matches("# " + license_scan.TEMPLATES[name].replace(". ", ".\n# "))] == [name]
