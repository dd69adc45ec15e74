"""Elimination hierarchies against plain searches, and how many rounds deep graphs take."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kitefin.operators import hierarchy, iterate


def table(spark, edges):
    return spark.createDataFrame([("k", a, b) for a, b in edges], "k string, src string, dst string")


def named(spark, names):
    return spark.createDataFrame([("k", n) for n in names], "k string, name string")


def after_of(edges):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    return after


def plain_depths(edges, seeds):
    after, found, at, depth = after_of(edges), {}, set(seeds), 0
    while at:
        depth += 1
        at = {b for a in at for b in after[a]} - found.keys()
        found |= dict.fromkeys(at, depth)
    return found


def plain_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {a: set(plain_depths(edges, [a])) for a in nodes}
    return {a: (min([a, *(b for b in reach[a] if a in reach[b])]), a in reach[a]) for a in nodes}


def rounds(monkeypatch):
    """How many levels each elimination had."""
    seen, keep = [], hierarchy.eliminate

    def count(*args, **kw):
        out = keep(*args, **kw)
        seen.append(len(out[0]))
        return out

    monkeypatch.setattr(hierarchy, "eliminate", count)
    return seen


@pytest.mark.parametrize("seed, few", [(1, 0), (2, 0), (2, 60), (1, 10_000)])
def test_random_graphs(spark, seed, few):
    """Sparse ones are eliminated whole; dense ones leave a core, for colours and rounds or for one task."""
    r = random.Random(seed)
    n = 40
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(60 if seed == 1 else 120)] + [("a", "b"), ("b", "a"), ("c", "c"), ("d", "e")]
    seeds = ["a", "n1", "n2"]
    got = {x.name: x.depth for x in iterate.reach(table(spark, edges), named(spark, seeds), "k", small_edges=few).collect()}
    assert got == plain_depths(edges, seeds)
    found = {x.name: (x.component, x.cyclic) for x in iterate.strong_components(table(spark, edges), "k", small_edges=few).collect()}
    assert found == plain_components(edges)


def test_keys_are_apart(spark):
    rows = [("p", "a", "b"), ("p", "b", "c"), ("q", "b", "a"), ("q", "a", "d"), ("q", "d", "b")]
    e = spark.createDataFrame(rows, "k string, src string, dst string")
    s = spark.createDataFrame([("p", "a"), ("q", "b")], "k string, name string")
    for few in (0, 100):
        assert sorted((x.k, x.name, x.depth) for x in iterate.reach(e, s, "k", small_edges=few).collect()) == [("p", "b", 1), ("p", "c", 2), ("q", "a", 1), ("q", "b", 3), ("q", "d", 2)]
        assert sorted((x.k, x.name, x.component, x.cyclic) for x in iterate.strong_components(e, "k", small_edges=few).collect()) == [("p", n, n, False) for n in "abc"] + [("q", n, "a", True) for n in "abd"]


def test_a_long_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    n = 10_000
    seen = rounds(monkeypatch)
    name = lambda c: F.format_string("n%05d", c)
    chain = spark.range(n).select(name(F.col("id")).alias("src"), name(F.col("id") + 1).alias("dst"))
    nodes = spark.range(n + 1).select(name(F.col("id")).alias("name"))
    got = iterate.reach(chain, nodes.limit(1).filter("name = 'n00000'"), small_edges=0)
    assert got.count() == n and got.filter("depth <> cast(substr(name, 2) as int)").isEmpty()
    assert 0 < seen[0] <= 2 * math.log2(n)


def test_peeling_goes_by_cycles(spark, monkeypatch):
    """Nothing on the chain is behind a cycle or a kept node but what the middle leads to."""
    n, seen = 200, rounds(monkeypatch)
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(n)] + [("x", "y"), ("y", "x"), ("y", "c150")]
    nodes = {a for e in chain for a in e} | {"alone"}
    left = iterate.peel(table(spark, chain), named(spark, nodes), named(spark, ["c100"]), "k", small_edges=0)
    assert {r.name for r in left.collect()} == {f"c{k:03d}" for k in range(100)} | {"alone"}
    assert max(seen) <= 2 * math.log2(n)


def test_ladders_and_rings_shrink_too(spark, monkeypatch):
    seen = rounds(monkeypatch)
    n = 24
    ladder = [(f"{a}{k}", f"{b}{k + 1}") for k in range(n) for a in "xy" for b in "xy"]
    got = {x.name: x.depth for x in iterate.reach(table(spark, ladder), named(spark, ["x0"]), "k", small_edges=0).collect()}
    assert got == plain_depths(ladder, ["x0"]) and seen[0] <= 3 * math.log2(2 * n)  # fewer of its nodes go a round than of a chain's
    ring = [(f"r{k}", f"r{(k + 1) % n}") for k in range(n)] + [("r5", "tail"), ("head", "r9")]
    found = iterate.strong_components(table(spark, ring), "k", small_edges=0)
    assert {(x.component, x.cyclic): x["count"] for x in found.groupBy("component", "cyclic").count().collect()} == {("r0", True): n, ("tail", False): 1, ("head", False): 1}
    assert max(seen) <= 3 * math.log2(2 * n)
