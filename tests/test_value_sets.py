"""Values that point at the same functions are followed and paired as one set."""

import pytest

from kitefin.operators import facts, iterate


@pytest.mark.parametrize("whole", [iterate.WHOLE_EDGES, 0])
def test_sets_are_the_rows_of_spread(spark, monkeypatch, whole):
    monkeypatch.setattr(iterate, "WHOLE_EDGES", whole)
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "d"), ("idle", "d"), ("x", "x"), ("u", None)]
    held = [("a", "v"), ("e", "w"), ("e", None), ("c", "v"), ("alone", "w")]
    nodes, sets = iterate.spread_sets(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([h for h in held if h[1]], "node string, value string"))
    contents = sorted(map(tuple, sets.collect()))
    got = sorted((n, v) for n, s in map(tuple, nodes.collect()) for t, v in contents if s == t)
    assert got == [("a", "v"), ("alone", "w"), ("b", "v"), ("c", "v"), ("d", "v"), ("d", "w"), ("e", "w")]


def test_program_edges_write_no_pairs_of_values_and_functions(spark, monkeypatch):
    """40 functions stored into p, p into 50 globals, each called with itself: 2,040 pairs, none written down."""
    functions, globals_ = [f"g{i}" for i in range(40)], [f"q{j}" for j in range(50)]
    rows, codes = [], []

    def add(opcode, *operands):
        codes.append(("m", "f", len(codes), opcode))
        rows.extend(("m", "f", len(codes) - 1, i, kind, target, False) for i, (kind, target) in enumerate(operands))

    for g in functions:
        add("store", ("func", g), ("gv", "p"))
    for q in globals_:
        add("store", ("gv", "p"), ("gv", q))
        add("call", ("gv", q), ("gv", q))
    operands = spark.createDataFrame(rows, "module string, func string, seq long, idx int, kind string, target string, is_pointer boolean")
    instructions = spark.createDataFrame(codes, "module string, func string, seq long, opcode string")
    none = lambda name: spark.createDataFrame([], f"module string, {name} string, kind string, target string")
    written = []

    def checkpoint(df, f=facts.checkpoint):
        found = f(df)
        written.append(found.count())
        return found

    monkeypatch.setattr(facts, "checkpoint", checkpoint)
    got = list(map(tuple, facts.program_edges(operands, instructions, none("id"), none("alias")).collect()))
    want = {("f", g) for g in functions} | {(a, b) for a in functions for b in functions if a != b} | {(f"__virtual__global__{v}", g) for v in ["p", *globals_] for g in functions}
    assert len(got) == len(want) and set(got) == want
    assert max(written) <= len(rows)
