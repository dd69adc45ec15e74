"""Registered queries that take whole tables, against plain Python."""

import datetime

import pytest

from kitefin.operators import iterate
from kitefin.plans import datasets as D
from kitefin.plans import queries as graph_queries


def test_closure_whole(spark):
    pairs = [("p1", "p2"), ("p2", "p3"), ("p3", "p1"), ("p9", "p4"), ("p4", "p3"), ("p5", "p5"), ("p6", None)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    loop = {(a, b) for a in ("p1", "p2", "p3", "p4", "p9") for b in ("p1", "p2", "p3")}
    want = loop | {("p9", "p4"), ("p5", "p5"), ("p6", None)}
    for most in (iterate.SMALL_EDGES, 0):
        assert sorted(map(tuple, iterate.closure(edges, small_edges=most).collect()), key=repr) == sorted(want, key=repr)


def test_registered_closure_is_whole(spark, sf_dir):
    after = {}
    for a, b in D.edges(spark, sf_dir).collect():
        after.setdefault(a, set()).add(b)
    want = set()
    for a in after:
        at, found = [a], set()
        while at:
            new = after.get(at.pop(), set()) - found
            found |= new
            at += new
        want |= {(a, b) for b in found}
    got = [tuple(r) for r in graph_queries.QUERIES["transitive_closure"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(a == b for a, b in got) and any(int(a[1:]) % 2 for a, _ in got)


def test_registered_replace_line_is_whole(spark, sf_dir):
    want = {(r.file, r.line_no): r.text for r in D.lines(spark, sf_dir).collect()}
    last = max(n for f, n in want if f == "d3")
    want |= {("d3", n): "" for n in range(last + 1, 10_000)} | {("d3", 10_000): "x"}
    got = graph_queries.QUERIES["replace_line"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r.file, r.line_no): r.text for r in got} == want


def test_registered_recommend_is_whole(spark, tmp_path):
    """Calls that no seventh line of an order makes count too."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp"
    day = lambda n: datetime.datetime(2020, 1, n)
    items = [(1, 1, 0, 1, day(1)), (1, 2, 0, 2, day(2)), (1, 3, 0, 3, day(3)), (2, 4, 0, 7, day(1)), (2, 5, 0, 7, day(2)), (3, 5, 0, 4, day(1)), (3, 4, 0, 5, day(2))]
    parts = [(1, 1), *((k, 2) for k in range(2, 7))]
    spark.createDataFrame(items, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "n", "Brand#1", "T", size) for k, size in parts], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in graph_queries.QUERIES["recommend"](spark, str(tmp_path)).collect()}
    assert got == {("p2", "INTERFACE"), ("p3", "NORMAL"), ("p4", "NORMAL"), ("p5", "NORMAL"), ("p6", "DELETE")}


@pytest.mark.parametrize("most", [iterate.SMALL_EDGES, 3, 0])
def test_peel_with_kept_nodes(spark, most):
    pairs = [("k", "a"), ("a", "b"), ("x", "k"), ("y", "x"), ("b", "k"), ("x", "z"), ("c", "d"), ("d", "c"), ("d", "e"), ("z", "w"), ("b", "w"), ("z", "v")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "kabxyzcdewvn"], "name string")
    got = sorted(r.name for r in iterate.peel(edges, nodes, spark.createDataFrame([("k",)], "name string"), small_edges=most).collect())
    assert got == sorted("xyzvn")
