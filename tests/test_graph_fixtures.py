"""Small hand-derived cases of each graph operator."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kitefin.functions import names as N
from kitefin.functions import text as T
from kitefin.operators import enrich, graph, iterate, labels, reports, rewrite
from kitefin.plans import advise
from kitefin.schema import RECOMMENDATION_COLOURS, TYPE_COLOURS
from kitefin.sources import graphs, makefiles, text_lines


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p.split(">")) for p in pairs], "src string, dst string")


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def pairs(df):
    return sorted(f"{r.src}>{r.dst}" for r in df.collect())


def listed(df):
    return sorted(r.name for r in df.collect())


def lines(spark, text, file="f.c"):
    return spark.createDataFrame([(file, k, t) for k, t in enumerate(text.split("\n"), 1)], "file string, line_no int, text string")


ADJACENCY = "a@isDefinition -> b@isDefinition b@isDefinition c@isDeclaration llvm.dbg.value \nb@isDefinition -> \nc@isDeclaration -> \nd.1@isDefinition -> a@isDefinition \n(garbage)\ne@isDefinition -> a@isDefinition "


def test_adjacency_text(spark):
    nodes, e = graphs.adjacency(lines(spark, ADJACENCY))
    assert listed(nodes) == ["a", "b"] and pairs(e) == ["a>b", "a>b", "a>c", "a>llvm.dbg.value"]
    nodes, e = graphs.adjacency(lines(spark, ADJACENCY), points_to=True)
    assert listed(nodes) == ["a", "b"] and pairs(e) == ["a>b", "a>c"]
    assert "d.1>a" in pairs(graphs.adjacency(lines(spark, ADJACENCY), strict_names=False)[1])


def test_recommendation(spark):
    own = ["f_exp>f_api", "f_api>f_help", "f_help>f_util", "f_rec>f_rec", "f_rec>f_leaf", "f_dead>f_dead2", "f_dead2>ext_fn"]
    names = ["f_exp", "f_api", "f_help", "f_util", "f_rec", "f_leaf", "f_dead", "f_dead2"]
    typed = labels.label_types(named(spark, *names), spark.createDataFrame([("EXPORT", "f_exp")], "label string, name string")).withColumn("subsystem", F.lit("/s"))
    found = advise.advise(typed, edges(spark, *own).withColumn("subsystem", F.lit("/s")), edges(spark, *own, "other>f_api")).collect()
    assert {r.name: r.recommendation for r in found} == {"f_api": "INTERFACE", "f_help": "NORMAL", "f_util": "NORMAL", "f_rec": "NORMAL", "f_leaf": "NORMAL", "f_dead": "DELETE", "f_dead2": "DELETE"}
    advice = spark.createDataFrame(found)
    ranks = {r.name: r["rank"] for r in reports.rank_components(advice.select("name", "component")).collect()}
    assert ranks == {"f_api": 0, "f_help": 0, "f_util": 0, "f_dead": 1, "f_dead2": 1, "f_leaf": 2, "f_rec": 2}
    (s,) = reports.summary(advice).collect()
    assert (s.SUBGRAPH, s.INTERFACE, s.DELETE, s.NORMAL) == (3, 1, 2, 4)


def test_label_priority(spark):
    said = [("INIT", "a"), ("EXPORT", "a"), ("TRACE", "a"), ("TRACE", "b"), ("EXPORT", "b"), ("USE_TRACE_SYSCALL", "c"), ("VIRTUAL_STRUCTS_REACH_TOP", "c"), ("OTHER", "d")]
    found = labels.label_types(named(spark, "a", "b", "c", "d"), spark.createDataFrame(said, "label string, name string"))
    assert {r.name: r.type for r in found.collect()} == {"a": "INIT", "b": "TRACE", "c": "USE_TRACE_SYSCALL", "d": "PLAIN"}


def test_acyclic_closure(spark):
    inner = edges(spark, "a>b", "b>c", "d>e", "e>d", "x>d")
    direct = spark.createDataFrame([("b", "f2"), ("c", "f1"), ("d", "f3"), ("e", "f4"), ("x", "f5")], "key string, value string")
    found = defaultdict(set)
    for r in iterate.acyclic_closure(inner, direct).collect():
        found[r.key].add(r.value)
    assert found == {"a": {"f1", "f2"}, "b": {"f1", "f2"}, "c": {"f1"}, "d": {"f3"}, "e": {"f4"}, "x": {"f5"}}


def test_enrich(spark):
    g = "__virtual__global__g"
    points = spark.createDataFrame([("1", "u", g), ("2", g, "h"), ("2", "p", "q")], "file string, src string, dst string")
    nodes = spark.createDataFrame([("1", "u"), ("2", "h"), ("2", "u")], "file string, name string")
    found = enrich.enrich(nodes, points.limit(0), points).collect()
    assert sorted(map(tuple, found)) == [("1", "u", "h"), ("2", "p", "q"), ("2", "u", "h")]


@pytest.mark.parametrize("small", [500_000, 0])
def test_reach_variants(spark, small):
    e = edges(spark, "i1>o", "p>i1", "q>p", "r>o")
    assert listed(iterate.reach(graph.reversed_edges(e), named(spark, "o"), through=named(spark, "i1"), small_edges=small)) == ["i1", "p", "r"]
    stack = edges(spark, "a>f", "b>f", "c>a", "b>a", "z>c")
    found = {r.name: r.depth for r in iterate.reach(graph.reversed_edges(stack), named(spark, "f"), most_depth=2, small_edges=small).collect()}
    assert found == {"a": 1, "b": 1, "c": 2}
    calls, inline = edges(spark, "h>k", "h>m", "h>e", "k>n2", "x>y", "y>x"), named(spark, "h", "k", "x", "y")
    assert listed(iterate.expand_inline(calls, named(spark, "h", "n"), inline, named(spark, "e"), small)) == ["m", "n", "n2"]
    assert listed(iterate.expand_inline(calls, named(spark, "x"), inline, named(spark, "e"), small)) == []


def test_random_graphs(spark):
    """Both ways of the iterative operators against plain worklists, all graphs as keys of one run."""
    r = random.Random(11)
    graphs_ = {k: [(str(r.randrange(9)), str(r.randrange(9))) for _ in range(r.randrange(14))] for k in range(25)}
    e = spark.createDataFrame([(k, a, b) for k, g in graphs_.items() for a, b in g], "k int, src string, dst string")
    n = spark.createDataFrame([(k, str(i)) for k in graphs_ for i in range(9)], "k int, name string")
    seeds, keep = n.filter("name in ('0', '1')"), n.filter("name = '3'")
    for small in (500_000, 0):
        reached, peeled, classes = defaultdict(dict), defaultdict(set), defaultdict(dict)
        for x in iterate.reach(e, seeds, "k", small_edges=small).collect():
            reached[x.k][x.name] = x.depth
        for x in iterate.peel(e, n, keep, "k", small_edges=small).collect():
            peeled[x.k].add(x.name)
        for x in iterate.components(e, n, "k", small_edges=small).collect():
            classes[x.k][x.name] = x.component
        for k, g in graphs_.items():
            want, at, depth = {}, {"0", "1"}, 0
            while at:
                depth += 1
                at = {b for a, b in g if a in at} - want.keys()
                want |= dict.fromkeys(at, depth)
            assert reached[k] == want
            left = set(map(str, range(9)))
            while gone := {x for x in left if x != "3" and not any(b == x and a in left for a, b in g)}:
                left -= gone
            assert peeled[k] == set(map(str, range(9))) - left
            root = {str(i): str(i) for i in range(9)}
            for _ in range(9):
                for a, b in g:
                    root[a] = root[b] = min(root[a], root[b])
            assert classes[k] == root


def test_contraction(spark):
    e = edges(spark, "k1>k2", "k1>x", "k1>y", "x>k2", "x>y")
    assert pairs(graph.contract(e, named(spark, "x", "y"), True)) == ["k1>k2", "k1>virtual_destination", "virtual_source>k2"]
    assert pairs(graph.contract(e, named(spark, "x", "y"), False)) == ["k1>k2"]


CODE = "static int\nfoo(int a)\n{\n    if (a) { return 1; }\n    return 0;\n}"


def test_source_text(spark):
    code = lines(spark, CODE)
    starts = spark.createDataFrame([("f.c", 2)], "file string, start int")
    assert text_lines.brace_spans(code, starts).collect()[0].end == 6
    assert text_lines.return_type_line(code, starts).collect()[0].first == 1
    macro = lines(spark, "#define A \\\n  1\nint x;\n#define B 2")
    assert [(r.line_no, r.text) for r in text_lines.macros(macro).orderBy("line_no").collect()] == [(1, "#define A 1"), (4, "#define B 2")]
    struct = lines(spark, "int x;\nstruct page {\n int a;\n};\n")
    assert [tuple(r)[1:] for r in text_lines.struct_definitions(struct).collect()] == [("page", 2, 4)]
    found = text_lines.includes(lines(spark, '#include <a.h>\n#include "b.h"\n #include <a.h>\n#include <c.h>')).collect()
    assert sorted((r.style, r.target, r.ordinal) for r in found) == [("angle", "a.h", 1), ("angle", "c.h", 2), ("quote", "b.h", 1)]


def test_read_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("x -> y\n\nz")
    (tmp_path / "b.bin").write_text("no")
    assert [(r.line_no, r.text) for r in text_lines.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, "x -> y"), (2, ""), (3, "z")]
    assert text_lines.latest_modification(spark, str(tmp_path)).first().latest is not None


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """A file is cut over tasks and numbered as a whole, carriage returns and all."""
    r = random.Random(3)
    want = {}
    for name, n, last in (("long.txt", 60_000, "\n"), ("crlf.txt", 9_000, ""), ("empty.txt", 0, ""), ("one.txt", 1, "")):
        rows = ["".join(r.choices("ab c{}é", k=r.randrange(30))) for _ in range(n)]
        rows[-1:] = ["end"] if n else []
        (tmp_path / name).write_bytes(("\r\n" if name == "crlf.txt" else "\n").join(rows).encode() + last.encode())
        want |= {(name, k + 1): t for k, t in enumerate(rows)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = text_lines.read_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(x.file.rsplit("/", 1)[-1], x.line_no): x.text for x in found.collect()} == want and found.count() == len(want)


def test_functions(spark):
    row = spark.range(1).select(
        T.signature(F.lit("static inline int *f(int (*g)(int), char c) { return g(c); } ")).alias("s"),
        T.first_parentheses(F.lit("no")).alias("none"),
        T.first_parentheses(F.lit("a(b(c)d)e)")).alias("pair"),
        T.c_type(F.lit("%struct.file**")).alias("t"),
        T.rename_word(F.lit("f(ff, f)"), "f", "mod_f").alias("renamed"),
        T.after_last(F.lit("/x/Kernel_src/a/Kernel_src/b.c"), "Kernel_src").alias("after"),
        T.join_path(F.lit("a/"), F.lit("/b")).alias("joined"),
        N.colour(F.lit("ODD"), TYPE_COLOURS).alias("odd"),
        N.colour(F.lit(None).cast("string"), RECOMMENDATION_COLOURS).alias("unset"),
        N.path_prefixes(F.lit("/a/b/c.x")).alias("above"),
        N.path_prefixes(F.lit("c.x")).alias("top"),
        N.default_type(F.lit(None).cast("string")).alias("type"),
        N.inline_or_unknown(F.lit(None).cast("boolean")).alias("unknown"),
        N.has_inline(F.lit("static inline int")).alias("inline"),
        N.virtual_init_name(F.lit("a/b-c.d")).alias("init"),
    ).first()
    assert tuple(row.s) == ("int *", "f", "int (*g)(int), char c", "{ return g(c); }")
    assert tuple(row.none) == (None, None) and tuple(row.pair) == (2, 8)
    assert (row.t, row.renamed, row.after, row.joined) == ("struct file * *", "mod_f(ff, mod_f)", "/b.c", "a/b")
    assert (row.odd, row.unset, row.above, row.top, row.type) == ("white", None, ["/a", "/a/b"], [], "PLAIN")
    assert row.unknown and row.inline and row.init == "a_b_c_d__virtual_init"


def test_rewriting(spark):
    code = lines(spark, "#include <a.h>\nint x;\nint y;")
    text = lambda df: [r.text for r in df.orderBy("line_no").collect()]
    assert text(rewrite.insert_at_first(code, "new", "int")) == ["#include <a.h>", "new", "int x;", "int y;"]
    assert text(rewrite.insert_after_last(code, "new", "#include", "#define")) == ["#include <a.h>", "new", "int x;", "int y;"]
    assert text(rewrite.replace_line(code, "f.c", 5, "z")) == ["#include <a.h>", "int x;", "int y;", "", "z"]
    span = spark.createDataFrame([("f.c", 2, 2)], "file string, start int, end int")
    assert text(rewrite.delete_ranges(code, span)) == ["#include <a.h>", "int y;"]
    moved = rewrite.move_bodies(code, span)
    assert text(moved.filter("file = 'f.c'")) == ["#include <a.h>", "", "int y;"] and text(moved.filter("file = 'f_code.c'")) == ["int x;"]
    # Beside an existing target: behind its last include or define, else on top; a function's lines stay together.
    at = lambda *rows: spark.createDataFrame([(f, k + 1, t) for f, whole in rows for k, t in enumerate(whole.split("\n"))], "file string, line_no int, text string")
    both = at(("f.c", "a\nb\n#define c\nd"), ("f_code.c", "#include <x>\nint k;\n  #define K 1\nint z;"), ("g.c", "u\nv"), ("g_code.c", "w"), ("h.c", "h"))
    spans = spark.createDataFrame([("f.c", 3, 9), ("f.c", 1, 2), ("f.c", 1, 2), ("g.c", 2, 2), ("none.c", 1, 5)], "file string, start int, end int")
    moved = rewrite.move_bodies(both, spans)
    assert moved.groupBy("file", "line_no").count().filter("count > 1").count() == 0
    found = {f: text(moved.filter(F.col("file") == f)) for f in ("f.c", "f_code.c", "g.c", "g_code.c", "h.c", "none_code.c")}
    assert found == {"f.c": [""] * 4, "f_code.c": ["#include <x>", "int k;", "  #define K 1", "a", "b", "#define c", "d", "int z;"], "g.c": ["u", ""], "g_code.c": ["v", "w"], "h.c": ["h"], "none_code.c": []}
    assert text(rewrite.module_include(code, code)) == ["#include <linux/module.h>", "#include <a.h>", "int x;", "int y;"]


def test_dot(spark):
    text = 'digraph G {\nnode [shape=box];\n"a.1" [file="/x/y", type=INIT];\nb;\n"\\n";\n"a.1" -> b;\nb -> c [style=dashed];\n}'
    nodes, e = graphs.dot(lines(spark, text))
    assert sorted((r.name, r.file, r.type) for r in nodes.collect()) == [("a.1", "/x/y", "INIT"), ("b", None, None)]
    assert pairs(e) == ["a.1>b", "b>c"]


def test_makefiles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    top = lines(spark, "obj-y += core.o sub/\nobj-$(CONFIG_A) += drv.o low/ \\\n   $(extra)\ndrv-objs := d1.o d2.o\ndrv-$(CONFIG_B) += d3.o\nextra := e.o $(none).o\nccflags-y := -g", "net")
    low = lines(spark, "obj-y := l.o", "net/low")
    sub = lines(spark, "obj-$(CONFIG_C) := s.o", "net/sub")
    found = makefiles.substitute(makefiles.statements(top.unionAll(low).unionAll(sub)))
    files = makefiles.descend(found, spark.createDataFrame([("net",)], "dir string"))
    assert sorted(map(tuple, files.collect())) == [("CONFIG_A", "net/d1.c"), ("CONFIG_A", "net/d2.c"), ("CONFIG_A", "net/e.c"), ("CONFIG_A", "net/low/l.c"), ("CONFIG_B", "net/d3.c"), ("CONFIG_C", "net/sub/s.c"), ("core", "net/core.c")]


def test_empty_graphs(spark):
    none, nobody = edges(spark, "a>b").limit(0), named(spark, "a").limit(0)
    for small in (500_000, 0):
        assert iterate.reach(none, named(spark, "a"), small_edges=small).count() == 0
        assert listed(iterate.peel(none, named(spark, "a"), small_edges=small)) == ["a"]
        assert listed(iterate.components(none, named(spark, "a"), small_edges=small)) == ["a"]
        assert iterate.components(none, nobody, small_edges=small).count() == 0
    assert iterate.closure(none).count() == 0
