"""Values, closures and components of graphs that fall apart, and of parts too large for a task, against plain Python."""

import pyarrow as pa
import pytest

from kitefin.operators import follow, iterate


def _graph():
    """Three chains into circles with tails, a loop, pairs, and an edge to nothing."""
    pairs = [("x", "x"), ("y", "z"), ("u", None)]
    for c in "abc":
        pairs += [(f"{c}{i}", f"{c}{i + 1}") for i in range(8)] + [(f"{c}7", f"{c}k0"), (f"{c}k24", f"{c}9")] + [(f"{c}k{i}", f"{c}k{(i + 1) % 30}") for i in range(30)] + [(f"{c}6", f"{c}3"), (f"{c}5", f"{c}9"), (f"{c}9", f"{c}10"), (f"{c}2", f"{c}11"), (f"{c}11", f"{c}9")]
    return pairs


def _behind(pairs, starts):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    found, at = set(starts), list(starts)
    while at:
        new = after.get(at.pop(), set()) - found
        found |= new
        at += new
    return found


@pytest.mark.parametrize("most", [iterate.SMALL_EDGES, 60, 20, 0])
def test_closure_and_values(spark, most):
    pairs = _graph()
    edges = spark.createDataFrame(pairs, "src string, dst string")
    want = {(a, b) for a, _ in pairs for b in _behind(pairs, {y for x, y in pairs if x == a})}
    got = list(map(tuple, iterate.closure(edges, small_edges=most).collect()))
    assert len(got) == len(want) and set(got) == want
    held = [("a0", "v"), ("b4", "v"), ("b4", "v"), ("c9", None), ("x", "w"), ("alone", "w"), (None, "w")]
    got = list(map(tuple, iterate.spread(edges, spark.createDataFrame(held, "node string, value string"), small_edges=most).collect()))
    plain = [p for p in pairs if p[1]]
    want = {(n, v) for node, v in held for n in _behind(plain, {node})}
    assert len(got) == len(want) and set(got) == want


def test_components_that_fit_take_no_rounds(spark, monkeypatch):
    """Ten chains of 30, each small: no round a link, as long as the chains are apart."""
    pairs = [(f"{c}{i:02}", f"{c}{i + 1:02}") for c in "abcdefghij" for i in range(30)]
    written = []
    monkeypatch.setattr(iterate, "checkpoint", lambda df, f=iterate.checkpoint: written.append(1) or f(df))
    got = iterate.spread(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("a00", "v"), ("c29", "w")], "node string, value string"), small_edges=30)
    assert {tuple(r) for r in got.collect()} == {(f"a{i:02}", "v") for i in range(31)} | {("c29", "w"), ("c30", "w")}
    assert len(written) <= 25


def test_rows_leave_in_batches():
    """A circle of 700 nodes leads to 490,000 pairs, of which a task never holds more than a batch and a node's own."""
    n = 700
    rows = [(0, 0, False, f"n{i}", f"n{(i + 1) % n}") for i in range(n)] + [(0, 0, True, f"n{i}", f"n{i}") for i in range(n)]
    names = ["key", "part", "held", "a", "b"]
    sizes = [b.num_rows for b in follow._follow([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 500])], names=names) for at in range(0, len(rows), 500)])]
    assert sum(sizes) == n * n and max(sizes) < follow.BATCH + n


def test_sets_leave_in_pieces():
    """The same circle as sets: far fewer names than pairs pass to Spark, and no piece makes more than SIDE * SIDE pairs."""
    n = 700
    rows = [(0, 0, False, f"n{i}", f"n{(i + 1) % n}") for i in range(n)] + [(0, 0, False, "x", "y"), (0, 0, False, "y", "n5")] + [(0, 0, True, f"v{i}", f"n{i}") for i in range(n)] + [(0, 0, True, None, "x")]
    batches = list(follow._follow([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "part", "held", "a", "b"])], sets=True))
    pieces = [(a, v) for b in batches for a, v in zip(*(c.to_pylist() for c in b.columns))]
    assert max(len(a) * len(v) for a, v in pieces) <= follow.SIDE**2 and sum(len(a) + len(v) for a, v in pieces) < n * n / 20
    pairs = [(a, v) for nodes, values in pieces for a in nodes for v in values]
    want = {(f"n{i}", v) for i in range(n) for v in [None, *(f"v{k}" for k in range(n))]} | {("x", None), ("y", None)}
    assert len(pairs) == len(want) and set(pairs) == want


def test_components_by_contraction(spark):
    pairs = [(f"a{i:02}", f"a{i + 1:02}") for i in range(40)] + [("b1", "b2"), ("c", "c"), ("b2", "b0")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} | {"alone"})], "name string")
    want = {(f"a{i:02}", "a00") for i in range(41)} | {("b0", "b0"), ("b1", "b0"), ("b2", "b0"), ("c", "c"), ("alone", "alone")}
    for most in (iterate.SMALL_EDGES, 10, 0):
        got = iterate.components(edges, nodes, small_edges=most)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_large_components_take_few_rounds_and_share_sets(spark, monkeypatch):
    """A chain into a circle with a chain behind it, too large for a task: no round a link, and fewer sets than nodes."""
    n = 100
    pairs = [(f"a{i:03}", f"a{i + 1:03}") for i in range(n)] + [(f"a{n:03}", "k0"), ("k0", "k1"), ("k1", "k2"), ("k2", "k0"), ("k1", "b000")] + [(f"b{i:03}", f"b{i + 1:03}") for i in range(n)]
    held = [(f"a{i:03}", f"v{i}") for i in range(0, n, 10)] + [("b100", "w")]
    edges, start = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(held, "node string, value string")
    written = []
    monkeypatch.setattr(iterate, "checkpoint", lambda df, f=iterate.checkpoint: written.append(1) or f(df))
    keyed, moving = (df.selectExpr("'' AS key", "*") for df in (edges, start))
    nodes, sets = (list(map(tuple, df.collect())) for df in iterate._value_sets(keyed, moving, 20))
    assert len(written) < n
    got = [(node, v) for node, s in nodes for t, v in sets if s == t]
    want = {(node, v) for start, v in held for node in _behind(pairs, {start})}
    assert len(got) == len(want) and set(got) == want
    assert len({t for _, t in nodes}) < len(nodes) / 2
