"""Operators that need no other documents, against plain Python over whole small tables."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kitefin.llm import chat_format, decontamination, mixing, quality, queries, secret_scan, token_count
from kitefin.llm._common import ASCII_LOWER

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return {r[0]: r.asDict() for r in df.collect()}


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def odd_documents(spark):
    """Nulls, empties, repeats, a long text, and columns named like the operators' own."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "é" * 70_000), (5, "a b c"), (5, "a b c"), (None, "password=abcdefgh1"), (6, "word " * 30_000)]
    made = [(i, t, None if k % 2 else "en", None if k % 3 else "s", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(made, DOCS).withColumns({c: F.lit("x") for c in ("blob", "kept", "size", "target", "stratum", "items", "row", "levels", "u_doc")})


# 1

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(docs, items):
    made = []
    for item, text in items:
        words = WORD.findall((text or "").translate(ASCII_LOWER))
        made += [(item, tuple(words[k : k + 10])) for k in range(max(1, len(words) - 9) if words else 0)]
    for doc, text in docs:
        words = WORD.findall((text or "").translate(ASCII_LOWER))
        places = defaultdict(list)
        for n in {len(w) for _, w in made}:
            for k in range(len(words) - n + 1):
                places[tuple(words[k : k + n])].append(k)
        hit, found = set(), set()
        for item, w in made:
            for k in places.get(w, ()):
                hit |= set(range(k, k + len(w)))
                found.add(str(item))
        yield doc, len(words), len(hit), len(found), SHA(",".join(sorted(found))), bool(hit)


def test_decontamination_query(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = sorted(brute_hits([(d.doc_id, d.text) for d in documents(spark, sf_dir)], [(b.item_id, b.text) for b in bench]))
    got = sorted(tuple(r) for r in queries.op1_decontamination(spark, sf_dir).collect())
    assert got == want and any(w[-1] for w in want)


def test_decontamination_blocks_and_spans(spark):
    docs = spark.createDataFrame([(1, "x A-b c, É9 tail"), (2, None), (3, ""), (4, "a b"), (4, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b", "z"), (9, "C é9", "z"), (None, "tail", "z"), (8, None, "z"), (10, "  ", "z")], "item_id long, text string, doc_id string")
    for most in (8_000_000, 1):
        got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items), tuple(map(tuple, r.spans))) for r in decontamination.decontaminate(docs, bench, max_pattern_chars=most).collect())
        assert got == [(1, 6, 3, ("7",), ((2, 5), (12, 16))), (2, 0, 0, (), ()), (3, 0, 0, (), ()), (4, 2, 2, ("7",), ((0, 3),)), (4, 2, 2, ("7",), ((0, 3),))]
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0
    assert decontamination.decontaminate(odd_documents(spark), bench).count() == 8


# 4


def brute_mix(docs, weights=(5, 2, 1)):
    sizes = [(d.doc_id, d.source, len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))) for d in docs]
    total, by = sum(s for *_, s in sizes), Counter()
    for _, source, s in sizes:
        by[source] += s
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), total
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * by[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * by[s]
            left -= 3 * by[s]
            free.remove(s)
    return sizes, by, target


def check_mix(got, docs):
    sizes, by, target = brute_mix(docs)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, n, by[s]) for i, s, n in sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in target:
        assert taken[s] == int(target[s] + 1e-9) or abs(taken[s] - target[s]) < 1


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n in (512, 2):
        check_mix(mixing.mix(docs, range_rows=n).collect(), docs.collect())
    small = docs.filter("doc_id % 3 < 2").withColumn("source", F.when(F.col("doc_id") < 3, F.lit("tiny")).when(F.col("doc_id") < 150, F.lit("big")))
    check_mix(mixing.mix(small).collect(), small.collect())
    check_mix(mixing.mix(odd_documents(spark)).collect(), odd_documents(spark).collect())
    assert mixing.mix(docs.limit(0)).count() == 0
    a, b = (sorted(map(tuple, queries.op4_source_mixing(spark, sf_dir).collect())) for _ in range(2))
    assert a == b


def test_mixing_prefix_sums(spark, sf_dir):
    got = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), range_rows=3).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for part in by.values():
        before = 0
        for r in sorted(part, key=lambda r: r.sort_key):
            assert r.words_before == before
            before += r.size


# 5

SECRETS = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def brute_secrets(text):
    least = {"assign": 8, "access": 16, "hex": 32}
    out = [(k, *m.span()) for k, p in SECRETS.items() for m in re.finditer(p, text, re.ASCII) if len(m[2] if k == "assign" else m[0]) >= least[k]]
    return sorted(out, key=lambda x: (x[1], list(SECRETS).index(x[0])))


TRICKY = ["token=a token: abcdefgh", "token:token: abcdefgh1", "ſecret=abcdefgh", 'API_KEY" : "aaaa.bbbb', "AKIA" + "A" * 11, "xAKIAAKIA" + "B" * 12, "é" + "0a" * 16, "password=" + "ab12" * 10, "0" * 31, "ghp_" + "Z1" * 20]


def test_secrets(spark, sf_dir):
    got = rows(queries.op5_secret_scan(spark, sf_dir))
    docs = documents(spark, sf_dir)
    assert len(got) == len(docs)
    for d in docs:
        want = brute_secrets(d.text or "")
        r = got[d.doc_id]
        assert [r[f"n_{k}"] for k in SECRETS] == [sum(x[0] == k for x in want) for k in SECRETS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == SHA(listed) and set(listed.split(",")) <= set(r["spans"].split(",")) | {""}
    for t in TRICKY:
        assert [x for x in secret_scan.find_secrets(t) if x[0] in SECRETS] == brute_secrets(t)
    assert [x[0] for x in secret_scan.find_secrets(TRICKY[-1])] == ["forge"]


def test_secret_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "token=abcdefgh1"), (3, None), (4, "")], "doc_id long, text string")
    first = secret_scan.scan_secrets(docs, path)
    assert sorted((r.doc_id, len(r.findings)) for r in first.collect()) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert spark.read.parquet(path).count() == 2
    more = docs.unionAll(spark.createDataFrame([(5, "token=abcdefgh1"), (6, "new AKIA" + "Z" * 12)], docs.schema))
    assert sorted(len(r.findings) for r in secret_scan.scan_secrets(more, path).collect()) == [0, 0, 1, 1, 1, 1]
    assert spark.read.parquet(path).count() == 3
    secret_scan.scan_secrets(docs, path, rule_version="2").collect()
    assert spark.read.parquet(path).groupBy("rule_version").count().count() == 2
    odd = odd_documents(spark)
    assert secret_scan.scan_secrets(odd, path).count() == 8 and secret_scan.scan_secrets(odd.limit(0), path).count() == 0
    clean = secret_scan.redact(odd, path)
    assert clean.columns == odd.columns
    assert Counter(r.text for r in clean.collect()) == Counter(["<secret>" if (r.text or "").startswith("pass") else r.text for r in odd.collect()])
    assert secret_scan._without("a token=abcdefgh1 0", [{"start": 2, "end": 17}, {"start": 8, "end": 12}]) == "a <secret> 0"


# 6


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, duplicates = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            duplicates += x in seen
            seen.add(x)
    found = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if found[tuple(words[k : k + 3])] > 1}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)]


def test_quality(spark, sf_dir):
    got = rows(queries.op6_quality_rules(spark, sf_dir))
    docs = documents(spark, sf_dir)
    assert len(got) == len(docs)
    for d in docs:
        want, r = brute_quality(d.text or ""), got[d.doc_id]
        assert [r[c] for c in quality.COUNTS] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = quality.assess(odd_documents(spark), labels)
    assert odd.count() == 8 and odd.filter("kept").count() == 0
    assert quality.assess(odd_documents(spark).limit(0), labels).count() == 0
    assert quality.assess(spark.createDataFrame(docs), labels.limit(0)).filter("size(rejected_by) > 0").count() == 0


def test_quality_cutoffs():
    from math import comb

    import numpy as np

    for n, p in ((50, 0.1), (400, 0.01)):
        exact = np.cumsum([comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(20)])
        assert quality.tail_at_most(np.arange(20), n, p) == pytest.approx(exact)
    good, bad = np.zeros(201, int), np.zeros(201, int)
    good[5], good[150], bad[100], bad[180] = 5000, 3, 40, 10
    cut = quality.choose_cutoff(good, bad, 0.01, 0.01)
    assert cut == 179
    good[150] = 0
    assert quality.choose_cutoff(good, bad, 0.01, 0.01) == 99
    assert quality.choose_cutoff(good // 100, bad, 0.01, 0.01) == quality.LEVELS


# 8


def formatted(role, text):
    return chat_format.TURN + chat_format.escape(role) + chat_format.BODY + chat_format.escape(text) + chat_format.END + "\n"


def test_chat(spark, sf_dir):
    got = rows(queries.op8_chat_format(spark, sf_dir))
    said = r"\### Assistant: </turn> ok"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for c, _, role, text in sorted([*turns, (-7, 0, "user", said), (-7, 1, "assistant", said)], key=lambda x: x[:2]):
        by[c].append((role, text or ""))
    assert got.keys() == by.keys()
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(said), SHA("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), SHA(loss))
        assert r["formatted_chars"] == sum(len(formatted(*x)) for x in said)


def test_chat_examples(spark):
    nasty = ["", "\\", "<|end|>", "\\<|end|>\\\\", "a\\<|turn|>user<|text|>", "<|end|", "|>\n", "\\\\\\<|text|>\\"]
    for t in nasty:
        assert chat_format.unescape(chat_format.escape(t)) == t
    text = "".join(formatted(r, t) for r, t in zip(nasty, nasty[::-1]))
    assert chat_format.parse(text) == list(zip(nasty, nasty[::-1]))
    with pytest.raises(ValueError):
        chat_format.parse("x" + text)
    made = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)] + [(2, None, None, None), (None, 1, "assistant", None), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("position", "piece", "end")})
    out = chat_format.expand(df)
    by = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r.position):
        by[r.conv_id].append(r)
    assert len(by[1]) == 8 and len(by[3]) == 2
    whole = [r.piece for r in by[1]]
    for r in by[1]:
        if r.example_end is not None:
            example = "".join(whole[: r.position + 1])
            assert len(example) == r.example_end and chat_format.unescape(example[r.loss_start : r.loss_end]) == nasty[r.turn]
    assert whole == [formatted(r or "", t or "") for _, _, r, t in made[:8]]
    written = {(r.conv_id, r.position): r for r in chat_format.examples(out).collect()}
    assert written.keys() == {(r.conv_id, r.position) for x in by.values() for r in x if r.example_end is not None}
    for (conv, position), r in written.items():
        assert r.text == "".join(x.piece for x in by[conv][: position + 1])
        assert (r.loss_start, r.loss_end) == (by[conv][position].loss_start, by[conv][position].loss_end)
    assert chat_format.read_back(out).count() == 4
    assert chat_format.read_back(chat_format.expand(df.limit(0))).count() == 0
    assert chat_format.examples(chat_format.expand(df.limit(0))).count() == 0


def test_chat_ties_and_backslashes(spark):
    """Equal turns are in the order of role, then text; long runs of backslashes take linear time."""
    made = [(1, 0, r, t) for r in ("user2", "user", None) for t in ("a ", "a", "=", "<|end|>", None)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(chat_format.expand(df).collect(), key=lambda r: r.position)
    assert [chat_format.parse(r.piece)[0] for r in got] == sorted((r or "", t or "") for _, _, r, t in made)
    long = ["\\" * 1_000_000 + "x", "<|end|>" + "\\" * 1_000_001]
    df = spark.createDataFrame([(k, 0, "assistant", t) for k, t in enumerate(long)], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.expand(df)).collect()}
    assert [(back[k].loss_chars, back[k].loss_sha256) for k in (0, 1)] == [(len(t), SHA(t)) for t in long]


# 10


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path(queries.TOKENIZER)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_counts(spark, sf_dir):
    got, t = rows(queries.op10_token_counts(spark, sf_dir)), library()
    for d in documents(spark, sf_dir):
        n = len(t.encode(d.text or "", add_special_tokens=False).ids)
        r = got[d.doc_id]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((d.text or "").encode()), n, n > 2048)
    assert token_count.count_tokens(odd_documents(spark), tokenizer_path()).count() == 8


def test_token_counts_of_odd_texts():
    with open(tokenizer_path(), "rb") as f:
        counter = token_count.Counter(f.read())
    t = library()
    texts = ["", None, "aaaaaaaaaaaaa" * 50, "=" * 3000, "x<|endoftext|>y <|startoftext|>", "I'm we'RE it's 1234 ½ ²", "ΑΣ ΣΑΣ İstanbul ǅ ß", "é 가 한글 中文字 ไทย", "a\x1cb\x1d c\x85d\xa0e f", "a​b ᠎ c", "🙂👩‍👩‍👧 <|endoftext|", " \n\t", "don't''s 'll'", "́x ́", "a" * 5000, "ab" * 4000]
    assert counter.count(texts) == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_token_counts_of_random_texts():
    import random

    with open(tokenizer_path(), "rb") as f:
        counter = token_count.Counter(f.read())
    t, r = library(), random.Random(5)
    letters = [*"abcdefghijklmnop   \n'.!1é", "ß", "İ", "Σ", "́", "ing", "the", "中", "\x1f"]
    texts = ["".join(r.choices(letters, k=r.randrange(200))) for _ in range(300)]
    assert counter.count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert json.loads(json.dumps(len(texts))) == 300
