"""Facts of small programs, values that spread, brace spans, ranges and reuse, by hand and against plain loops."""

import random
import time

import pytest

from kitefin.operators import facts, iterate, rewrite
from kitefin.sources import graphs, sinks, text_lines

OPERANDS = "module string, func string, seq long, idx int, kind string, target string, is_pointer boolean"
INSTRUCTIONS = "module string, func string, seq long, opcode string"


def program(spark, *said):
    """Instructions of module m as (func, seq, opcode, operands), an operand being `kind:target`, with a * if a pointer."""
    rows = [("m", f, s, k, o.strip("*").split(":")[0], o.strip("*").split(":")[1], o.endswith("*")) for f, s, _, ops in said for k, o in enumerate(ops)]
    return spark.createDataFrame(rows, OPERANDS), spark.createDataFrame([("m", f, s, c) for f, s, c, _ in said], INSTRUCTIONS)


def inner(spark, node, rows=()):
    return spark.createDataFrame([("m", *r) for r in rows], f"module string, {node} string, kind string, target string")


def pairs(df):
    return sorted(f"{r.src}>{r.dst}" for r in df.select("src", "dst").collect())


def test_call_edges(spark):
    operands, instructions = program(
        spark,
        ("f", 1, "call", ["func:get"]),
        ("f", 2, "load", ["local:1"]),
        ("f", 3, "store", ["func:handler", "local:9"]),
        ("f", 4, "store", ["local:9", "func:target"]),
        ("f", 5, "phi", ["func:a", "func:b"]),
        ("f", 6, "invoke", ["local:5", "func:passed"]),
        ("f", 7, "load", ["func:read"]),
        ("f", 8, "call", ["func:llvm.dbg.value"]),
        ("g", 9, "load", ["local:1"]),
    )
    assert pairs(facts.call_edges(operands, instructions)) == ["f>a", "f>b", "f>get", "f>handler", "f>passed"]
    assert pairs(facts.loaded_calls(operands, instructions)) == ["f>get"]


def test_program_edges(spark):
    operands, instructions = program(
        spark,
        ("f", 1, "store", ["func:cb", "gv:table*"]),  # f>cb, global>cb
        ("f", 2, "store", ["local:3", "alias:al*"]),  # through the alias of a global
        ("f", 3, "bitcast", ["const:c"]),  # f>deep: the result points at it
        ("f", 4, "call", ["local:3", "func:arg", "local:5"]),  # f>deep
        ("f", 5, "bitcast", ["func:other"]),  # f>other, passed on: deep>other
        ("f", 6, "call", ["func:known", "local:5"]),  # f>known, known>other
        ("f", 7, "call", ["func:other", "local:5"]),  # a function isn't passed to itself
        ("g", 8, "bitcast", ["gv:table"]),  # not through a global
        ("g", 9, "phi", ["const:c"]),
        ("g", 10, "call", ["func:make", "local:11*"]),
        ("g", 11, "bitcast", ["const:none"]),
    )
    constants, aliases = inner(spark, "id", [("c", "const", "d"), ("d", "func", "deep")]), inner(spark, "alias", [("al", "gv", "hidden"), ("fa", "func", "x")])
    gv = "__virtual__global__"
    assert pairs(facts.program_edges(operands, instructions, constants, aliases)) == sorted([f"{gv}table>cb", f"{gv}hidden>deep", "f>cb", "f>deep", "deep>other", "f>other", "f>known", "known>other", "g>deep", "g>make"])


def test_arguments_absorb_what_a_call_gives(spark):
    operands, instructions = program(spark, ("f", 1, "call", ["func:pick", "local:2*", "local:3"]), ("f", 4, "call", ["local:2"]), ("f", 5, "call", ["local:3"]))
    moved = facts.copies(operands, instructions)
    assert [(r.src, r.dst) for r in moved.collect()] == [("m\tf\tlocal\t1", "m\tf\tlocal\t2")]
    taken = spark.createDataFrame([("m\tf\tlocal\t1", "chosen")], "value string, func string")
    assert sorted(r.value for r in facts.points_to(moved, taken).collect()) == ["m\tf\tlocal\t1", "m\tf\tlocal\t2"]


def test_used_names(spark):
    operands, _ = program(spark, ("f", 1, "call", ["func:a", "const:c", "gv:g"]), ("f", 2, "call", ["alias:x", "func:llvm.dbg"]))
    constants, aliases = inner(spark, "id", [("c", "gv", "h"), ("c", "func", "b")]), inner(spark, "alias", [("x", "alias", "y"), ("y", "func", "z")])
    declared = spark.createDataFrame([("a", "a.c"), ("z", "z.c")], "name string, file string")
    assert sorted(map(tuple, facts.used_functions(operands, constants, aliases, declared).collect())) == [("f", "a", "a.c"), ("f", "b", None), ("f", "z", "z.c")]
    types = spark.createDataFrame([("g", "[3 x i8*]")], "name string, type string")
    assert sorted(map(tuple, facts.used_globals(operands, constants, aliases, types).collect())) == [("f", "g", "char * []"), ("f", "h", None)]


@pytest.mark.parametrize("small", [0, 10_000])
def test_spread(spark, small):
    r = random.Random(3)
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(40)]
    held = [(f"n{r.randrange(35)}", f"v{k % 4}") for k in range(12)]
    want, more = set(held), True
    while more:
        new = {(b, v) for a, b in edges for n, v in want if n == a} - want
        want, more = want | new, bool(new)
    got = iterate.spread(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(held, "node string, value string"), small).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_nodes_without_edges(spark):
    """Nodes that no edge touches are components of their own and are peeled, in either way."""
    edges = spark.createDataFrame([("a", "b"), ("c", "c")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcxyz"], "name string")
    keep = nodes.filter("name = 'y'")
    for small in (0, 10):
        assert sorted(map(tuple, iterate.components(edges, nodes, small_edges=small).select("name", "component").collect())) == [("a", "a"), ("b", "a"), ("c", "c"), ("x", "x"), ("y", "y"), ("z", "z")]
        assert sorted(r.name for r in iterate.peel(edges, nodes, keep, small_edges=small).collect()) == ["a", "b", "x", "z"]


def table(spark, files):
    return spark.createDataFrame([(f, k, t) for f, text in files.items() for k, t in enumerate(text, 1)], "file string, line_no int, text string")


def test_brace_spans(spark):
    r = random.Random(9)
    files = {f"f{n}": ["".join(r.choices("{} x", [3, 3, 4, 4], k=r.randrange(5))) for _ in range(r.randrange(1, 30))] for n in range(25)}

    def end(text, start):
        level = opened = 0
        for k in range(start, len(text) + 1):
            opened = opened or "{" in text[k - 1]
            if opened:
                level += text[k - 1].count("{") - text[k - 1].count("}")
                if level <= 0:
                    return k
        return start

    starts = [(f, k) for f, text in files.items() for k in range(1, len(text) + 1) if r.random() < 0.6] + [("f0", 999)]
    got = text_lines.brace_spans(table(spark, files), spark.createDataFrame(starts, "file string, start int")).collect()
    assert {(x.file, x.start): x.end for x in got} == {(f, k): end(files[f], k) for f, k in starts}


def test_ranges(spark):
    lines = table(spark, {"a": list("uvwx"), "b": ["y"]})
    ranges = spark.createDataFrame([("a", 3, 10**9, "p"), ("a", -5, 3, "q"), ("b", 2, 5, "r"), ("c", 1, 2, "s"), ("a", 3, 2, "t")], "file string, start long, end long, name string")
    got = sorted((r.file, r.line_no, r.text, r.name) for r in text_lines.line_slice(lines, ranges).collect())
    assert got == [("a", 1, "u", "q"), ("a", 2, "v", "q"), ("a", 3, "w", "p"), ("a", 3, "w", "q"), ("a", 4, "x", "p")]
    assert sorted(map(tuple, rewrite.delete_ranges(lines, ranges).collect())) == [("b", 1, "y")]


def test_export_macros(spark):
    lines = table(spark, {"a.c": ["int x[3];"], "b.c": ["#include <linux/export.h>", "int y[2];", "EXPORT_SYMBOL(y);"]})
    wanted = spark.createDataFrame([("a.c", "x"), ("a.c", "x"), ("b.c", "y"), ("b.c", "z")], "file string, name string")
    got = {}
    for r in sorted(rewrite.export_macros(lines, wanted).collect()):
        got.setdefault(r.file, []).append(r.text)
    assert got == {"a.c": ["int x[3];", "#include <linux/export.h>", "EXPORT_SYMBOL(x);"], "b.c": ["#include <linux/export.h>", "int y[2];", "EXPORT_SYMBOL(y);", "EXPORT_SYMBOL(z);"]}


def test_locations(spark):
    known = spark.createDataFrame([("g", "a.c", True), ("g", "a.c", True), ("h", "b.c", False), ("k", None, True)], "name string, file string, has_initialiser boolean")
    assert [tuple(r) for r in graphs.global_locations(known).collect()] == [("g", "a.c")]


def test_reuse(spark, tmp_path):
    source, path, built = tmp_path / "in", str(tmp_path / "out"), []
    source.mkdir()
    (source / "x.dot").write_text("a")

    def build():
        built.append(1)
        return spark.range(len(built))

    assert sinks.reuse(spark, str(source), path, build).count() == 1
    assert sinks.reuse(spark, str(source), path, build).count() == 1
    time.sleep(0.05)
    (source / "y.dot").write_text("b")
    assert sinks.reuse(spark, str(source), path, build).count() == 2
