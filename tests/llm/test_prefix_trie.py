"""Prefix tries against dictionaries of prefixes."""

import hashlib
import zlib

import numpy as np
import pytest

from kitefin.llm import prefix_trie as T

SCHEMA = "hi string, conv_id long, turn long, role string, text string, depth int"


def plain(rows):
    turns: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members: dict = {}
    ends: dict = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        made = turns.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(made) + 1):
            members.setdefault(tuple(made[:d]), []).append(c)
        ends.setdefault(tuple(made), []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def run(spark, rows, **kw):
    df = spark.createDataFrame([("x", *r, 3) for r in rows], SCHEMA).repartition(4)
    found = T.prefixes(df, **kw).collect()
    assert len({(r.hi, r.lo) for r in found}) == len(found)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)


def conversations(n, seed, longest=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(1000, n, replace=False).tolist():
        for k in range(int(rng.integers(1, longest))):
            say = ["hallo", "straße", "𝄞", ""][int(rng.integers(0, 4))] if rng.random() < 0.7 else f"own {c} {k}"
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", "hallo" if k == 0 and c % 3 else say))
    return rows


@pytest.mark.parametrize("shard_nodes,deep_nodes", [(512, 1000), (3, 1), (20, 40)])
def test_against_dictionaries(spark, shard_nodes, deep_nodes):
    rows = conversations(90, 3)
    copies = [(2000 + c, k, "user", f"turn {k}") for c in range(12) for k in range(24)]  # deeper than all cuts
    odd = [(5, None, "user", "null turn"), (5, 0, None, None), (5, 0, "b", "x"), (5, 0, "a", "y"), (5, 0, "a", "y"), (-3, 1, "user", "below zero"), (None, 0, "user", "nobody"), (4001, 0, "user", "alone"), (4100, 7, "u", "z" * 3000)]
    rows = [r for r in rows if r[0] != 5] + copies + odd
    assert run(spark, rows, shard_nodes=shard_nodes, deep_nodes=deep_nodes) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    short = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1][:5]
    rows = [(c, 0, "user", "one turn") for c in short]  # taken off, and there is no conversation 0
    got = run(spark, rows)
    assert got == plain(rows) and got[0][1:6] == (0, -1, 5, 0, 1)


def test_ends_of_a_hot_node_in_chunks(spark, monkeypatch):
    rows = [(c, k, "user", f"same {k}") for c in range(600) for k in range(6)]
    monkeypatch.setattr(T, "CHUNK_IDS", 7)
    got = run(spark, rows, shard_nodes=2)
    assert got == plain(rows) and len(got) == 7


def test_empty_table_and_one_turn(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "nobody's")]) == []
    assert run(spark, [(8, 0, "user", "x")]) == plain([(8, 0, "user", "x")])


def test_louds_navigation():
    #      0        1
    #    2 3 4      5
    #    6   7 8
    parent = np.array([-1, -1, 0, 0, 0, 1, 2, 4, 4])
    depth = np.array([1, 1, 2, 2, 2, 2, 3, 3, 3])
    name = np.arange(9)
    mixed = np.random.default_rng(1).permutation(9)
    trie, order = T.Louds.build(name[mixed], parent[mixed], depth[mixed])
    assert trie.labels.tolist() == list(range(9)) and mixed[order].tolist() == list(range(9))
    assert "".join(map(str, trie.bits)) == "110" + "1110" + "10" + "10" + "0" + "110" + "0" + "0" * 3
    assert trie.parents().tolist() == parent.tolist()
    assert trie.degrees().tolist() == [3, 1, 1, 0, 2, 0, 0, 0, 0]
    assert list(trie.children(-1)) == [0, 1] and list(trie.children(0)) == [2, 3, 4] and list(trie.children(4)) == [7, 8] and list(trie.children(3)) == []
    assert trie.find(4, 8) == 8 and trie.find(4, 6) is None and trie.find(-1, 1) == 1
    assert trie.rollup(np.ones(9, np.int64)).tolist() == [7, 2, 2, 1, 3, 1, 1, 1, 1]
    assert trie.rollup(np.ones(9, np.int64), leaf=True).tolist() == [4, 1, 1, 1, 2, 1, 1, 1, 1]


def test_written_tries_hold_the_nodes(spark):
    rows = conversations(60, 4)
    df = spark.createDataFrame([("x", *r, 3) for r in rows], SCHEMA)
    nodes = {(r.hi, r.lo): r for r in T.prefixes(df).collect()}
    seen = 0
    for r in T.tries(df).collect():
        labels = np.frombuffer(r.labels, [("hi", "i8"), ("lo", "i8")])
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8))[: r.n_bits]
        trie = T.Louds(bits, labels)
        seen += len(labels)
        for k, (label, degree, n) in enumerate(zip(labels.tolist(), trie.degrees().tolist(), r.n_convs)):
            node = nodes[label]
            assert node.n_convs == n and (n == 1 or node.n_children == degree), (k, label)
    assert seen == sum(1 for r in nodes.values() if r.depth and (r.n_convs > 1 or r.depth == 1 or _shared_parent(nodes, r)))


def _shared_parent(nodes, r):
    return any(q.depth == r.depth - 1 and q.conv_id == r.parent_conv_id and q.n_convs > 1 for q in nodes.values())
