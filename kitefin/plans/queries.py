"""One query for each operator over the derived graphs, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import enrich, facts, graph, iterate, labels, reports, rewrite
from ..sources import graphs, makefiles, text_lines
from . import advise as A
from . import rollup as R
from . import datasets as D
from .datasets import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _typed(spark, sf):
    wanted = D.labels(spark, sf).filter("label <> 'INLINE'")
    return labels.label_types(D.nodes(spark, sf), wanted).select("name", "file", "type")


def _label(spark, sf, *wanted):
    return labels.names(D.labels(spark, sf), *wanted)


# Scans

_KEPT_LINES = "k AS (SELECT * FROM a WHERE line_no < coalesce((SELECT min(line_no) FROM a AS g WHERE g.file = a.file AND g.text NOT LIKE '%->%'), 1000000000))"
_PARSED = r"p AS (SELECT file, regexp_extract(text, '^([\w@]+) -> (.*)', 1) AS head, list_filter(regexp_split_to_array(regexp_extract(text, '^([\w@]+) -> (.*)', 2), '\s+'), lambda x: x <> '') AS callees FROM k)"


@query(with_("n", "e", "a", _KEPT_LINES, _PARSED) + "SELECT file, src, dst, count(*) AS n FROM (SELECT file, split_part(head, '@', 1) AS src, split_part(unnest(callees), '@', 1) AS dst FROM p WHERE head <> '') GROUP BY ALL")
def scan_adjacency_text(spark, sf):
    return graphs.adjacency(D.adjacency_lines(spark, sf))[1].groupBy("file", "src", "dst").agg(F.count("*").alias("n"))


@query(with_("n", "e", "a", _KEPT_LINES, _PARSED) + "SELECT DISTINCT file, split_part(head, '@', 1) AS name FROM p WHERE head LIKE '%@isDefinition'")
def scan_adjacency_nodes(spark, sf):
    return graphs.adjacency(D.adjacency_lines(spark, sf))[0]


@query(with_("n", "e", "a", _KEPT_LINES, _PARSED) + "SELECT file, src, dst, count(*) AS n FROM (SELECT file, split_part(head, '@', 1) AS src, split_part(unnest(list_distinct(list_filter(callees, lambda x: x NOT LIKE '%llvm.%'))), '@', 1) AS dst FROM p WHERE head <> '') GROUP BY ALL")
def scan_points_to_text(spark, sf):
    return graphs.adjacency(D.adjacency_lines(spark, sf), points_to=True)[1].groupBy("file", "src", "dst").agg(F.count("*").alias("n"))


def _dot_lines(spark, sf):
    text = graphs.render_dot(_typed(spark, sf), D.edges(spark, sf))
    return text.select(F.lit("all.dot").alias("file"), F.lit(0).alias("line_no"), "text")


@query(with_("n", "l", "t") + "SELECT name, file, type FROM t")
def scan_dot_nodes(spark, sf):
    return graphs.dot(_dot_lines(spark, sf))[0].select("name", "file", "type")


@query(with_("e") + "SELECT src, dst FROM e")
def scan_dot_edges(spark, sf):
    return graphs.dot(_dot_lines(spark, sf))[1]


@query(with_("n") + "SELECT brand AS name, arg_max(file, id) AS file FROM n GROUP BY brand")
def scan_file_attributes(spark, sf):
    text = F.concat(F.lit('"'), "brand", F.lit('" [file="'), "file", F.lit('", type=PLAIN];'))
    return graphs.file_attributes(D.nodes(spark, sf).select(F.col("id").alias("line_no"), text.alias("text")))


@query(with_("e") + "SELECT DISTINCT src, dst FROM e WHERE CAST(substr(src, 2) AS BIGINT) % 3 > 0")
def scan_identifier_edges(spark, sf):
    number = F.substring(F.col("src"), 2, 20).cast("long") % 3
    left = F.when(number == 0, F.concat(F.lit("1"), F.lit("."))).otherwise(F.concat(F.lit('"'), "src", F.lit('"')))
    text = F.when(number == 0, F.lit("-> none")).otherwise(F.concat(left, F.lit(" -> "), "dst", F.lit(";")))
    return graphs.identifier_edges(D.edges(spark, sf).select(text.alias("text")))


@query(with_("n") + "SELECT DISTINCT trim(title) AS name FROM n WHERE id % 5 > 0")
def scan_symbol_list(spark, sf):
    text = F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "title", F.lit(" ")))
    return text_lines.symbol_list(D.nodes(spark, sf).select(text.alias("text")))


@query(with_("n") + "SELECT DISTINCT CASE WHEN id % 5 = 0 THEN '' ELSE title END AS name FROM n")
def scan_export_set(spark, sf):
    text = F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "title"))
    return text_lines.symbol_list(D.nodes(spark, sf).select(text.alias("text")), keep_blank=True)


_SYMBOLS = "s AS (SELECT brand AS file, CASE WHEN id % 4 = 1 THEN '__kstrtab_' || name WHEN id % 4 = 2 THEN 'trace_' || name WHEN id % 8 = 3 THEN '__x64_sys_' || name ELSE name END AS name, CASE WHEN id % 4 = 0 THEN '.init.text' WHEN id % 4 = 1 THEN '__ksymtab_strings' ELSE '.text' END AS section FROM n)"


@query(
    with_("n", _SYMBOLS, "w AS (SELECT file FROM s GROUP BY file HAVING bool_or(section = '.init.text') AND bool_or(section = '__ksymtab_strings'))", "k AS (SELECT s.* FROM s SEMI JOIN w USING (file))")
    + "SELECT DISTINCT * FROM (SELECT 'INIT' AS label, name FROM k WHERE section = '.init.text' UNION ALL SELECT 'EXPORT', replace(name, '__kstrtab_', '') FROM k WHERE section = '__ksymtab_strings' AND name LIKE '%\\_\\_kstrtab\\_%' ESCAPE '\\' UNION ALL SELECT 'TRACE', name FROM k WHERE section = '.text' AND name LIKE '%trace%' UNION ALL SELECT 'SYSCALL', name FROM k WHERE regexp_matches(name, '^__(ia32_|x64_|se_|do_sys)'))"
)
def classify_elf_symbols(spark, sf):
    i = F.col("id")
    name = F.when(i % 4 == 1, F.concat(F.lit("__kstrtab_"), "name")).when(i % 4 == 2, F.concat(F.lit("trace_"), "name")).when(i % 8 == 3, F.concat(F.lit("__x64_sys_"), "name")).otherwise(F.col("name"))
    section = F.when(i % 4 == 0, ".init.text").when(i % 4 == 1, "__ksymtab_strings").otherwise(".text")
    return graphs.classify_symbols(D.nodes(spark, sf).select(F.col("brand").alias("file"), name.alias("name"), section.alias("section")))


@query(with_("n") + "SELECT DISTINCT 'CONFIG_' || name AS config FROM n WHERE size % 2 = 0")
def scan_config_modules(spark, sf):
    text = F.concat(F.lit("CONFIG_"), "name", F.when(F.col("size") % 2 == 0, "=m").otherwise("=y"))
    return text_lines.config_modules(D.nodes(spark, sf).select(text.alias("text")))


def _makefile(spark, sf):
    """A makefile a directory /type/brand: core, config and composite objects, a variable, a ccflags line."""
    n = D.nodes(spark, sf)
    directory, i = F.regexp_extract("file", "^(.*)/f", 1), F.col("id")
    forms = F.when(i % 6 == 0, F.concat(F.lit("obj-y += "), "name", F.lit(".o"))).when(i % 6 == 1, F.concat(F.lit("obj-$(CONFIG_"), (i % 10).cast("string"), F.lit(") += \\"))).when(i % 6 == 2, F.concat("name", F.lit("-objs := "), "name", F.lit("a.o "), "name", F.lit("b.o"))).when(i % 6 == 3, F.concat("name", F.lit("-$(CONFIG_"), (i % 10).cast("string"), F.lit(") += "), "name", F.lit("c.o"))).when(i % 6 == 4, F.lit("ccflags-$(CONFIG_DEBUG) += -g")).otherwise(F.concat(F.lit("obj-$(CONFIG_"), (i % 10).cast("string"), F.lit(") += p"), (i - 3).cast("string"), F.lit(".o")))
    first = n.select(directory.alias("file"), (i * 2).cast("int").alias("line_no"), forms.alias("text"))
    second = n.filter(i % 6 == 1).select(directory.alias("file"), (i * 2 + 1).cast("int").alias("line_no"), F.concat(F.lit("  "), "name", F.lit(".o sub/")).alias("text"))
    return first.unionByName(second)


_MAKE = "m AS (SELECT regexp_extract(file, '^(.*)/f', 1) AS dir, * FROM n), r AS (SELECT dir, 'core' AS config, name || '.o' AS target FROM m WHERE id % 6 = 0 UNION ALL SELECT dir, 'CONFIG_' || (id % 10), unnest([name || '.o', 'sub/']) FROM m WHERE id % 6 = 1 UNION ALL SELECT dir, 'CONFIG_' || (id % 10), 'p' || (id - 3) || '.o' FROM m WHERE id % 6 = 5), o AS (SELECT dir AS o_dir, name || '.o' AS whole, unnest([name || 'a.o', name || 'b.o']) AS member FROM m WHERE id % 6 = 2), s AS (SELECT dir, config, coalesce(member, target) AS target FROM r LEFT JOIN o ON o_dir = dir AND whole = target UNION ALL SELECT dir, 'CONFIG_' || (id % 10), name || 'c.o' FROM m WHERE id % 6 = 3)"


@query(with_("n", _MAKE) + "SELECT dir, config, target, count(*) AS n FROM s GROUP BY ALL")
def makefile_rules(spark, sf):
    return makefiles.substitute(makefiles.statements(_makefile(spark, sf))).groupBy("dir", "config", "target").agg(F.count("*").alias("n"))


def _makefile_tree(spark, sf):
    """The same with a makefile in each brand's directory sub, which adds core files and a file of its own config."""
    n = D.nodes(spark, sf).filter("id % 6 = 1").select(F.concat(F.regexp_extract("file", "^(.*)/f", 1), F.lit("/sub")).alias("file"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("obj-y += "), "name", F.lit("s.o")).alias("text"))
    return _makefile(spark, sf).unionByName(n)


_TREE = "f AS (SELECT config, dir || '/' || replace(target, '.o', '.c') AS file FROM s WHERE target NOT LIKE '%/' UNION SELECT s.config, q.dir || '/sub/' || q.name || 's.c' FROM s JOIN m AS q ON q.dir = s.dir AND q.id % 6 = 1 WHERE s.target = 'sub/')"


@query(with_("n", _MAKE, _TREE) + "SELECT config, file FROM f")
def makefile_descent(spark, sf):
    found = makefiles.substitute(makefiles.statements(_makefile_tree(spark, sf)))
    return makefiles.descend(found, found.filter("not endswith(dir, '/sub')").select("dir").distinct())


@query(with_("n", _MAKE, _TREE) + "SELECT DISTINCT file FROM f WHERE config IN ('CONFIG_1', 'CONFIG_3') AND file NOT IN (SELECT file FROM f WHERE config = 'core')")
def module_files(spark, sf):
    modules = spark.createDataFrame([("CONFIG_1",), ("CONFIG_3",)], "config string")
    return makefiles.module_files(makefile_descent(spark, sf), modules)


@query(with_("n") + "SELECT name AS func, file || '.c' AS file, size AS line FROM n WHERE id % 3 > 0")
def debug_locations(spark, sf):
    i = F.col("id")
    text = F.explode(F.array(F.concat(F.lit("define i32 @"), "name", F.lit("(i32 %0) "), F.when(i % 3 > 0, F.concat(F.lit("!dbg !"), (i * 2).cast("string"))).otherwise(""), F.lit(" {")), F.concat(F.lit("!"), (i * 2).cast("string"), F.lit(" = distinct !DISubprogram(name: "), "name", F.lit(", file: !"), (i * 2 + 1).cast("string"), F.lit(", line: "), F.col("size").cast("string"), F.lit(", scope: !1)")), F.concat(F.lit("!"), (i * 2 + 1).cast("string"), F.lit(' = !DIFile(filename: "'), F.substring(F.col("file"), 2, 100), F.lit('.c", directory: "/home/x/Kernel_src")'))))
    return graphs.debug_locations(D.nodes(spark, sf).select(F.lit("m").alias("file"), F.lit(0).alias("line_no"), text.alias("text")), "Kernel_src").drop("module")


# Names

_NAMED = "x AS (SELECT name, CASE id % 7 WHEN 0 THEN '__virtual__global__' || name WHEN 1 THEN '\"__virtual__global__' || name || '\"' WHEN 2 THEN name || '__virtual_init' WHEN 3 THEN '__ia32_' || name WHEN 4 THEN 'perf_' || name WHEN 5 THEN 'llvm.' || name ELSE '__do_compat_sys' || name END AS said FROM n)"


def _said(spark, sf):
    i, name = F.col("id") % 7, F.col("name")
    said = F.when(i == 0, F.concat(F.lit("__virtual__global__"), name)).when(i == 1, F.concat(F.lit('"__virtual__global__'), name, F.lit('"'))).when(i == 2, F.concat(name, F.lit("__virtual_init"))).when(i == 3, F.concat(F.lit("__ia32_"), name)).when(i == 4, F.concat(F.lit("perf_"), name)).when(i == 5, F.concat(F.lit("llvm."), name)).otherwise(F.concat(F.lit("__do_compat_sys"), name))
    return D.nodes(spark, sf).select("name", said.alias("said"))


@query(with_("n", _NAMED) + r"SELECT name, regexp_replace(said, '^\"|\"$', '', 'g') AS clean, CASE WHEN said LIKE '%\_\_virtual\_\_global\_\_%' ESCAPE '\' THEN 'GV' ELSE 'FUNC' END AS kind, said LIKE 'llvm.%' AS intrinsic, said LIKE '%\_\_virtual\_init' ESCAPE '\' AS init, regexp_matches(said, '^__(ia32_|x64_|se_|do_sys|do_compat_sys)') AS syscall, said LIKE 'perf%' AS trace FROM x")
def name_classify(spark, sf):
    s = F.col("said")
    return _said(spark, sf).select("name", N.clean_name(s).alias("clean"), N.kind(s).alias("kind"), N.is_intrinsic(s).alias("intrinsic"), N.is_virtual_init(s).alias("init"), N.is_syscall(s).alias("syscall"), N.is_trace(s).alias("trace"))


@query(with_("n", _NAMED) + r"SELECT name FROM x WHERE NOT (said LIKE 'perf%' OR regexp_matches(said, '^__(ia32_|x64_|se_|do_sys|do_compat_sys)') OR said LIKE '%\_\_virtual\_init' ESCAPE '\')")
def untraced_names(spark, sf):
    kept = labels.untraced(_said(spark, sf).select(F.col("name").alias("real"), F.col("said").alias("name")))
    return kept.select(F.col("real").alias("name"))


@query(with_("n", "f AS (SELECT file || CASE id % 4 WHEN 0 THEN '.dot' WHEN 1 THEN '.mod.dot' WHEN 2 THEN '/all.dot' ELSE '.txt' END AS path FROM n)") + "SELECT DISTINCT path FROM f WHERE path LIKE '%.dot' AND path NOT LIKE '%mod.dot' AND path NOT LIKE '%/all.dot%'")
def graph_files(spark, sf):
    i = F.col("id") % 4
    path = F.concat("file", F.when(i == 0, ".dot").when(i == 1, ".mod.dot").when(i == 2, "/all.dot").otherwise(".txt"))
    return D.nodes(spark, sf).select(path.alias("path")).distinct().filter(N.is_graph_file(F.col("path")))


@query(with_("n") + "SELECT name, CASE WHEN id % 5 = 0 OR size % 4 = 0 THEN 'SKIP' WHEN size % 3 = 0 THEN 'ARRAY' ELSE 'VARIABLE' END AS handling, id % 2 = 0 AS header FROM n")
def global_handling(spark, sf):
    name = F.when(F.col("id") % 5 == 0, F.concat("name", F.lit(".1"))).otherwise(F.col("name"))
    kind = F.when(F.col("size") % 4 == 0, "").when(F.col("size") % 3 == 0, "int []").otherwise("int *")
    path = F.concat("file", F.when(F.col("id") % 2 == 0, ".h").otherwise(".c"))
    return D.nodes(spark, sf).select("name", N.global_handling(name, kind).alias("handling"), N.is_header(path).alias("header"))


@query(with_("n") + "SELECT brand, list_sort(list(name) FILTER (size % 2 = 0))::VARCHAR[] IS NOT NULL AS any_left, count(*) FILTER (size % 2 = 0) AS n FROM n GROUP BY brand")
def resolved_files(spark, sf):
    named = F.when(F.col("size") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("$("), "name", F.lit(")")))
    kept = N.resolved(F.collect_list(named))
    return D.nodes(spark, sf).groupBy("brand").agg(kept.alias("kept")).select("brand", (F.size("kept") > 0).alias("any_left"), F.size("kept").cast("long").alias("n"))


# Labels and set operations


@query(with_("n", "l", "t") + "SELECT name, type, CASE type WHEN 'INIT' THEN 'red' WHEN 'SYSCALL' THEN 'purple' WHEN 'TRACE' THEN 'darkgreen' WHEN 'EXPORT' THEN 'blue' WHEN 'MODULAR' THEN 'orange' WHEN 'VIRTUAL_STRUCTS' THEN 'brown' WHEN 'USE_TRACE_SYSCALL' THEN 'cyan' WHEN 'VIRTUAL_STRUCTS_REACH_TOP' THEN 'goldenrod' ELSE 'white' END AS colour FROM t")
def label_priority(spark, sf):
    return _typed(spark, sf).select("name", "type", N.type_colour(F.col("type")).alias("colour"))


@query(with_("n", "e", "l", "t", "h AS (SELECT name, type FROM t WHERE file NOT LIKE '%Brand#1/%')") + "SELECT name, type FROM h UNION ALL SELECT DISTINCT name, 'EXTERNAL' FROM (SELECT src AS name FROM e UNION SELECT dst FROM e) WHERE name NOT IN (SELECT name FROM h)")
def dangling_endpoints(spark, sf):
    return graph.complete(_typed(spark, sf).filter("file not like '%Brand#1/%'"), D.edges(spark, sf))


_FOLDER = "h AS (SELECT name, type FROM t WHERE file LIKE '/SMALL/%'), g AS (SELECT src, dst FROM fe WHERE file LIKE '/SMALL/%'), c AS (SELECT name FROM h UNION SELECT src FROM g UNION SELECT dst FROM g), k AS (SELECT src, dst FROM g UNION SELECT src, dst FROM e WHERE dst IN (SELECT name FROM c))"


def _folder(spark, sf):
    nodes = _typed(spark, sf).filter("file like '/SMALL/%'")
    own = D.file_edges(spark, sf).filter("file like '/SMALL/%'").select("src", "dst")
    return graph.external_callers(graph.complete(nodes, own), own, D.edges(spark, sf))


@query(with_("n", "e", "fe", "l", "t", _FOLDER) + "SELECT src, dst FROM k")
def external_callers(spark, sf):
    return _folder(spark, sf)[1]


@query(with_("n", "e", "fe", "l", "t", _FOLDER) + "SELECT name, coalesce(type, 'EXTERNAL') AS type FROM (SELECT name FROM c UNION SELECT src FROM k UNION SELECT dst FROM k) LEFT JOIN h USING (name)")
def external_nodes(spark, sf):
    return _folder(spark, sf)[0]


@query(with_("n", "e") + "SELECT DISTINCT dst AS name FROM e WHERE src IN (SELECT name FROM n WHERE size = 11) AND dst NOT IN (SELECT name FROM n WHERE size = 11)")
def virtual_struct_top(spark, sf):
    return graph.successors_outside(D.edges(spark, sf), _label(spark, sf, "VIRTUAL_STRUCTS"))


@query(with_("n", "l") + "SELECT name FROM l WHERE label = 'EXPORT' INTERSECT SELECT name FROM l WHERE label = 'INLINE'")
def symbol_intersect(spark, sf):
    return labels.intersect(_label(spark, sf, "EXPORT"), _label(spark, sf, "INLINE"))


@query(with_("n", "l") + "SELECT name FROM l WHERE label = 'EXPORT' EXCEPT SELECT name FROM l WHERE label = 'INLINE'")
def symbol_difference(spark, sf):
    return labels.difference(_label(spark, sf, "EXPORT"), _label(spark, sf, "INLINE"))


@query(with_("n", "l") + "SELECT name FROM l WHERE label IN ('TRACE', 'SYSCALL') GROUP BY name")
def symbol_union(spark, sf):
    return labels.union(_label(spark, sf, "TRACE"), _label(spark, sf, "SYSCALL"))


@query("SELECT true AS same, false AS other")
def symbol_equal(spark, sf):
    a, b = _label(spark, sf, "TRACE"), _label(spark, sf, "EXPORT")
    same = labels.equal(a, a.union(a)).withColumnRenamed("equal", "same")
    other = labels.equal(a, b).withColumnRenamed("equal", "other")
    return same.withColumn("k", F.lit(1)).join(other.withColumn("k", F.lit(1)), "k").drop("k")


@query(with_("n") + "SELECT name FROM n WHERE file IN (SELECT file FROM n WHERE brand = 'Brand#5' AND size % 2 = 0)")
def modular_functions(spark, sf):
    files = D.nodes(spark, sf).filter("brand = 'Brand#5' and size % 2 = 0").select("file")
    return labels.declared_in(D.nodes(spark, sf), files)


@query(with_("n", "e", "l") + "SELECT DISTINCT dst AS name FROM e WHERE dst NOT IN (SELECT name FROM l WHERE label = 'EXPORT') AND dst NOT IN (SELECT name FROM n WHERE brand = 'Brand#2')")
def unexported_symbols(spark, sf):
    used = D.edges(spark, sf).select(F.col("src").alias("func"), F.col("dst").alias("name"))
    return labels.unexported(used, _label(spark, sf, "EXPORT"), D.nodes(spark, sf).filter("brand = 'Brand#2'"))


# Graphs

_DEGREES = "SELECT {0} AS src, count(*) AS degree, min({1}) AS first, max({1}) AS last FROM {2} GROUP BY 1"


def _degrees(edges):
    n = F.col("neighbours")
    return graph.adjacency(edges).select("src", F.size(n).cast("long").alias("degree"), n[0].alias("first"), F.element_at(n, -1).alias("last"))


@query(with_("e") + _DEGREES.format("src", "dst", "e"))
def adjacency_forward(spark, sf):
    return _degrees(D.edges(spark, sf))


@query(with_("e") + _DEGREES.format("dst", "src", "e"))
def adjacency_reverse(spark, sf):
    return _degrees(graph.reversed_edges(D.edges(spark, sf)))


@query(with_("e") + _DEGREES.format("src", "dst", "(SELECT src, dst FROM e UNION SELECT dst, src FROM e)"))
def adjacency_undirected(spark, sf):
    return _degrees(graph.undirected(D.edges(spark, sf)))


def _graphs(spark, sf):
    """Graphs of brands: titles are declared in many."""
    n = D.nodes(spark, sf)
    named = n.filter("id % 3 > 0").groupBy("brand", "title").agg(F.min("file").alias("file")).select(F.col("brand").alias("graph"), F.col("title").alias("name"), "file")
    a, b = n.select(F.col("name").alias("src"), F.col("title").alias("a"), F.col("brand").alias("graph")), n.select(F.col("name").alias("dst"), F.concat("title", (F.col("id") % 3).cast("string")).alias("b"))
    return named, D.edges(spark, sf).join(a, "src").join(b, "dst").select("graph", F.col("a").alias("src"), F.col("b").alias("dst"))


_GRAPHS = "g AS (SELECT brand AS graph, title AS name, min(file) AS file FROM n WHERE id % 3 > 0 GROUP BY 1, 2), x AS (SELECT a.brand AS graph, a.title AS src, b.title || (b.id % 3) AS dst FROM e JOIN n AS a ON a.name = src JOIN n AS b ON b.name = dst), m AS (SELECT name, {}(file, graph) AS file FROM g GROUP BY name)"
_UNITED = "SELECT name, file FROM m UNION ALL SELECT name, NULL FROM (SELECT src AS name FROM x UNION SELECT dst FROM x) WHERE name NOT IN (SELECT name FROM m)"


@query(with_("n", "e", _GRAPHS.format("arg_min")) + _UNITED)
def union_first_wins(spark, sf):
    return graph.union_first_wins(*_graphs(spark, sf))[0]


@query(with_("n", "e", _GRAPHS.format("arg_max")) + _UNITED)
def union_last_wins(spark, sf):
    return graph.union_last_wins(*_graphs(spark, sf))[0]


@query(with_("n", "e", _GRAPHS.format("arg_min")) + "SELECT DISTINCT src, dst FROM x")
def union_edges(spark, sf):
    return graph.union_first_wins(*_graphs(spark, sf))[1]


@query(with_("n", "e", "fe", "s AS (SELECT '/' || split_part(file, '/', 2) AS subsystem, title AS name, file FROM n WHERE id % 2 = 0 UNION ALL SELECT '/' || split_part(fe.file, '/', 2), n.title, fe.file FROM fe JOIN n ON fe.src = n.name)") + "SELECT subsystem, name, min(file) AS file FROM s GROUP BY 1, 2")
def folder_union(spark, sf):
    top = F.concat(F.lit("/"), F.split("file", "/")[1])
    n = D.nodes(spark, sf)
    e = D.file_edges(spark, sf).join(n.select(F.col("name").alias("src"), "title"), "src").select("file", F.col("title").alias("src"), "dst")
    return graph.folder_union(n.filter("id % 2 = 0").select(top.alias("subsystem"), F.col("title").alias("name"), "file"), e.select(top.alias("subsystem"), "file", "src", "dst"))


_DROPPED = "x AS (SELECT name FROM t WHERE type IN ('INIT', 'EXPORT', 'TRACE', 'VIRTUAL_STRUCTS', 'SYSCALL', 'MODULAR', 'USE_TRACE_SYSCALL'))"
_CONTRACTED = "SELECT DISTINCT CASE WHEN src IN (SELECT name FROM x) THEN 'virtual_source' ELSE src END AS src, CASE WHEN dst IN (SELECT name FROM x) THEN 'virtual_destination' ELSE dst END AS dst FROM e WHERE NOT (src IN (SELECT name FROM x) AND dst IN (SELECT name FROM x))"


@query(with_("n", "e", "l", "t", _DROPPED) + _CONTRACTED)
def contract_virtual(spark, sf):
    return graph.filter_nodes(D.edges(spark, sf), _typed(spark, sf), F.col("type").isin(*graph.NON_MODULAR), True)


@query(with_("n", "e", "l", "t", _DROPPED) + "SELECT src, dst FROM e WHERE src NOT IN (SELECT name FROM x) AND dst NOT IN (SELECT name FROM x)")
def contract_drop(spark, sf):
    return graph.filter_nodes(D.edges(spark, sf), _typed(spark, sf), F.col("type").isin(*graph.NON_MODULAR), False)


@query(
    with_("n", "e", "fe", "l", "t", _FOLDER, "o AS (SELECT name FROM (SELECT src AS name FROM k UNION SELECT dst FROM k) WHERE name NOT IN (SELECT name FROM h))", "u AS (SELECT DISTINCT CASE WHEN src IN (SELECT name FROM o) THEN 'virtual_source' ELSE src END AS src, CASE WHEN dst IN (SELECT name FROM o) THEN 'virtual_destination' ELSE dst END AS dst FROM k WHERE NOT (src IN (SELECT name FROM o) AND dst IN (SELECT name FROM o)))", _DROPPED)
    + _CONTRACTED.replace("FROM e ", "FROM u ")
)
def simplify_folder(spark, sf):
    return graph.simplify(*_folder(spark, sf))[1]


# Iterative operators


@query(with_("n", "e", "r(name) AS (SELECT dst FROM e JOIN n ON src = n.name WHERE size = 1 UNION SELECT dst FROM r JOIN e ON src = r.name)", recursive=True) + "SELECT name FROM r WHERE name NOT IN (SELECT name FROM n WHERE size = 1)")
def init_reach(spark, sf):
    init = _label(spark, sf, "INIT")
    return labels.difference(iterate.reach(D.edges(spark, sf), init), init)


@query(with_("n", "e", "o AS (SELECT name FROM n WHERE size IN (3, 20))", "r(name) AS (SELECT src FROM e JOIN o ON dst = o.name WHERE src NOT IN (SELECT name FROM o) UNION SELECT src FROM r JOIN e ON dst = r.name JOIN n ON n.name = r.name WHERE n.size % 3 = 0 AND src NOT IN (SELECT name FROM o))", recursive=True) + "SELECT name FROM r")
def tainted_callers(spark, sf):
    origin = D.nodes(spark, sf).filter("size in (3, 20)").select("name")
    return iterate.reach(graph.reversed_edges(D.edges(spark, sf)), origin, through=_label(spark, sf, "INLINE")).select("name")


@query(with_("n", "e", "r(name, d) AS (SELECT name, 0 FROM n WHERE size = 50 UNION SELECT src, d + 1 FROM r JOIN e ON dst = r.name WHERE d < 5)", recursive=True) + "SELECT DISTINCT src, dst FROM e WHERE dst IN (SELECT name FROM r WHERE d < 5)")
def call_stack(spark, sf):
    start, back = D.nodes(spark, sf).filter("size = 50").select("name"), graph.reversed_edges(D.edges(spark, sf))
    near = labels.union(start, iterate.reach(back, start, most_depth=4))
    return D.edges(spark, sf).join(near.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")


_G = "'\\_\\_virtual\\_\\_global\\_\\_%' ESCAPE '\\'"
_CLOSURE = f"gg AS (SELECT DISTINCT src, dst FROM b WHERE src LIKE {_G} AND dst LIKE {_G}), dd AS (SELECT DISTINCT src AS key, dst AS value FROM b WHERE src LIKE {_G} AND dst NOT LIKE {_G}), w(src, dst) AS (SELECT src, dst FROM gg UNION SELECT w.src, gg.dst FROM w JOIN gg ON w.dst = gg.src), y AS (SELECT src AS name FROM w WHERE src = dst), bad AS (SELECT name FROM y UNION SELECT src FROM w WHERE dst IN (SELECT name FROM y)), u AS (SELECT key, value FROM dd UNION SELECT w.src, dd.value FROM w JOIN dd ON w.dst = dd.key WHERE w.src NOT IN (SELECT name FROM bad))"


@query(with_("n", "b", _CLOSURE, recursive=True) + "SELECT key, value FROM u")
def gv_closure(spark, sf):
    return enrich.global_users(D.global_edges(spark, sf))[0]


@query(
    with_("n", "e", "fe", "b", _CLOSURE, recursive=True)
    + f"SELECT file, src, dst FROM fe UNION SELECT b.file, b.src, u.value FROM b JOIN u ON b.dst = u.key WHERE b.src NOT LIKE {_G} UNION SELECT b.file, c.src, b.dst FROM b JOIN (SELECT DISTINCT src, dst FROM b WHERE src NOT LIKE {_G} AND dst LIKE {_G}) AS c ON c.dst = b.src JOIN n ON n.name = c.src AND n.file = b.file WHERE b.src LIKE {_G} AND b.dst NOT LIKE {_G}"
)
def enrich_edges(spark, sf):
    return enrich.enrich(D.nodes(spark, sf).select("file", "name"), D.file_edges(spark, sf), D.global_edges(spark, sf))


_ADVICE = (
    "s AS ({subsystems}), ek AS (SELECT q.subsystem, e.src, e.dst, p.name IS NOT NULL AS inside FROM e JOIN s AS q ON q.name = e.dst LEFT JOIN s AS p ON p.name = e.src AND p.subsystem = q.subsystem), "
    "c(subsystem, src, dst) AS (SELECT subsystem, src, dst FROM ek WHERE inside UNION SELECT c.subsystem, c.src, ek.dst FROM c JOIN ek ON ek.inside AND ek.subsystem = c.subsystem AND ek.src = c.dst), "
    "i AS (SELECT DISTINCT subsystem, dst AS name FROM ek WHERE NOT inside), "
    "v AS (SELECT subsystem, name FROM i UNION SELECT subsystem, src FROM c WHERE src = dst), "
    "z AS (SELECT subsystem, name FROM v UNION SELECT c.subsystem, c.dst FROM c JOIN v ON v.subsystem = c.subsystem AND v.name = c.src), "
    "k(subsystem, name, other) AS (SELECT subsystem, name, name FROM s UNION SELECT k.subsystem, k.name, j.y FROM k JOIN (SELECT subsystem, src AS x, dst AS y FROM ek WHERE inside UNION SELECT subsystem, dst, src FROM ek WHERE inside) AS j ON j.subsystem = k.subsystem AND j.x = k.other), "
    "av AS (SELECT s.subsystem, s.name, CASE WHEN i.name IS NOT NULL THEN 'INTERFACE' WHEN z.name IS NULL THEN 'DELETE' ELSE 'NORMAL' END AS recommendation, (SELECT min(other) FROM k WHERE k.subsystem = s.subsystem AND k.name = s.name) AS component FROM s LEFT JOIN i ON i.subsystem = s.subsystem AND i.name = s.name LEFT JOIN z ON z.subsystem = s.subsystem AND z.name = s.name)"
)
_PLAIN = "type IN ('PLAIN', 'VIRTUAL_STRUCTS_REACH_TOP')"
_ALL_ADVICE = _ADVICE.format(subsystems=f"SELECT unnest(['/' || split_part(file, '/', 2), '/' || split_part(file, '/', 2) || '/' || split_part(file, '/', 3)]) AS subsystem, name FROM t WHERE {_PLAIN}")
_WHOLE_ADVICE = _ADVICE.format(subsystems=f"SELECT '/' AS subsystem, name FROM t WHERE {_PLAIN}")


@query(with_("n", "whole_e", "l", "t", _WHOLE_ADVICE, recursive=True) + "SELECT name, recommendation FROM av")
def recommend(spark, sf):
    """Advice over the calls that all lines of an order make."""
    return A.advise_staged(_typed(spark, sf), D.whole_edges(spark, sf))


@query(with_("n", "e", "l", "t", _ALL_ADVICE, recursive=True) + "SELECT subsystem, name, recommendation, component FROM av")
def recommend_by_subsystem(spark, sf):
    nodes, edges = A.by_subsystem(_typed(spark, sf), D.file_edges(spark, sf))
    return A.advise(nodes, edges, D.edges(spark, sf))


@query(with_("n", "e", "l", "t", _ALL_ADVICE, recursive=True) + "SELECT subsystem, name, recommendation, component FROM av")
def recommend_rollup(spark, sf):
    """The same advice bottom-up, each edge once."""
    return R.advise_rollup(_typed(spark, sf).select("name", "file", "type"), D.edges(spark, sf))


@query(with_("e", "r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)", "m AS (SELECT DISTINCT unnest([src, dst]) AS name FROM e)", "b AS (SELECT x.src AS name, min(x.dst) AS least FROM r AS x JOIN r AS y ON x.src = y.dst AND x.dst = y.src GROUP BY 1)", recursive=True) + "SELECT name, coalesce(least, name) AS component, least IS NOT NULL AS cyclic FROM m LEFT JOIN b USING (name)")
def strong_components(spark, sf):
    """Functions that call one another in a circle, by elimination alone."""
    return iterate.strong_components(D.edges(spark, sf), small_edges=0)


@query(with_("n", "e", "l", "t", _ALL_ADVICE, recursive=True) + "SELECT subsystem, count(DISTINCT component) AS \"SUBGRAPH\", count(*) FILTER (recommendation = 'INTERFACE') AS \"INTERFACE\", count(*) FILTER (recommendation = 'DELETE') AS \"DELETE\", count(*) FILTER (recommendation = 'NORMAL') AS \"NORMAL\" FROM av GROUP BY 1")
def summary_counts(spark, sf):
    return reports.summary(recommend_by_subsystem(spark, sf))


@query(with_("n", "e", "l", "t", _ALL_ADVICE, recursive=True) + "SELECT CAST(sum(g) AS BIGINT) AS \"SUBGRAPH\", CAST(sum(i) AS BIGINT) AS \"INTERFACE\", CAST(sum(d) AS BIGINT) AS \"DELETE\", CAST(sum(m) AS BIGINT) AS \"NORMAL\" FROM (SELECT count(DISTINCT component) AS g, count(*) FILTER (recommendation = 'INTERFACE') AS i, count(*) FILTER (recommendation = 'DELETE') AS d, count(*) FILTER (recommendation = 'NORMAL') AS m FROM av WHERE subsystem NOT LIKE '/%/%' GROUP BY subsystem)")
def summary_total(spark, sf):
    return reports.total(summary_counts(spark, sf))


@query(with_("n", "e", "l", "t", _ALL_ADVICE, recursive=True) + "SELECT subsystem FROM (SELECT DISTINCT unnest(['/' || split_part(file, '/', 2), '/' || split_part(file, '/', 2) || '/' || split_part(file, '/', 3)]) AS subsystem FROM n) WHERE subsystem NOT IN (SELECT subsystem FROM av)")
def zero_modules(spark, sf):
    every = D.nodes(spark, sf).select(F.explode(N.path_prefixes(F.col("file"))).alias("subsystem"))
    return reports.all_zero_subsystems(reports.completed(summary_counts(spark, sf), every))


_MEMBERS = "k(name, other) AS (SELECT name, name FROM n UNION SELECT k.name, j.y FROM k JOIN (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e) AS j ON j.x = k.other), m AS (SELECT name, min(other) AS component FROM k GROUP BY name)"


@query(with_("n", "e", _MEMBERS, recursive=True) + "SELECT name, component FROM m")
def components(spark, sf):
    return iterate.components(D.edges(spark, sf), D.nodes(spark, sf))


@query(with_("n", "e", _MEMBERS, recursive=True) + "SELECT name, CAST(rank AS BIGINT) AS rank, size FROM m JOIN (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS rank FROM m GROUP BY 1) USING (component)")
def component_rank(spark, sf):
    return reports.rank_components(components(spark, sf)).select("name", F.col("rank").cast("long").alias("rank"), "size")


@query(with_("n", "e", "r(name) AS (SELECT name FROM n WHERE size = 6 UNION SELECT dst FROM r JOIN n ON n.name = r.name JOIN e ON src = r.name WHERE n.size % 3 = 0 AND dst NOT IN (SELECT name FROM n WHERE size % 7 = 0))", recursive=True) + "SELECT r.name FROM r JOIN n ON n.name = r.name WHERE size % 3 <> 0")
def inline_expand(spark, sf):
    start = D.nodes(spark, sf).filter("size = 6").select("name")
    return iterate.expand_inline(D.edges(spark, sf), start, _label(spark, sf, "INLINE"), _label(spark, sf, "EXPORT"))


@query(with_("n", "e", "c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)", recursive=True) + "SELECT src, dst FROM c")
def transitive_closure(spark, sf):
    """All paths of graph A, through cycles too."""
    return iterate.closure(D.edges(spark, sf))


# Reports


@query(with_("n") + "SELECT DISTINCT regexp_extract(file, '^(.*)/[^/]*$', 1) AS directory FROM n")
def module_dirs(spark, sf):
    return D.nodes(spark, sf).select(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("directory")).distinct()


def _locations(spark, sf):
    return D.nodes(spark, sf).filter("id % 9 > 0").select("name", F.col("file").alias("real_file"), F.col("size").alias("start_loc"))


@query(with_("n") + "SELECT name, file AS real_file, size AS start_loc, row_number() OVER (PARTITION BY file ORDER BY size DESC, name) AS turn FROM n WHERE id % 9 > 0")
def location_sort(spark, sf):
    return reports.locate(D.nodes(spark, sf).select("name"), _locations(spark, sf)).select("name", "real_file", "start_loc", F.col("turn").cast("long").alias("turn"))


@query(with_("n") + "SELECT name FROM n WHERE id % 9 = 0")
def unlocated_functions(spark, sf):
    return reports.unlocated(D.nodes(spark, sf).select("name"), _locations(spark, sf))


@query(with_("n") + "SELECT file AS real_file, count(*) AS n, max(size) AS last FROM n WHERE id % 9 > 0 GROUP BY 1")
def functions_by_file(spark, sf):
    grouped = reports.functions_by_file(_locations(spark, sf))
    return grouped.select("real_file", F.size("functions").cast("long").alias("n"), F.col("functions")[0]["start_loc"].alias("last"))


@query(with_("n", "e") + "SELECT src, dst, file FROM e LEFT JOIN (SELECT name, file FROM n WHERE id % 9 > 0) ON name = dst")
def files_of_callees(spark, sf):
    declared = D.nodes(spark, sf).filter("id % 9 > 0")
    return reports.files_of(D.edges(spark, sf).select("src", F.col("dst").alias("name")), declared).select("src", F.col("name").alias("dst"), "file")


@query(with_("n") + "SELECT CASE WHEN size % 3 = 0 THEN 'NORMAL' ELSE 'INTERFACE' END AS handle_way, count(*) FILTER (id % 4 > 0) AS handled FROM n GROUP BY 1")
def handle_counts(spark, sf):
    said = F.when(F.col("size") % 3 == 0, "NORMAL").when(F.col("size") % 3 == 1, "INTERFACE").otherwise("DELETE")
    return reports.handled(D.nodes(spark, sf).select(reports.handle_way(said).alias("handle_way"), (F.col("id") % 4 > 0).alias("ok")))


@query("SELECT count(*) AS total, count(*) FILTER (html LIKE '%<nav>%') AS rewritten, count(*) FILTER (html LIKE '%<nav>%' AND html LIKE '%track(1%') AS built FROM pages")
def log_outcomes(spark, sf):
    return text_lines.build_outcomes(D.table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("content")), "<nav>", "track(1")


@query("SELECT event_type, max(ts) AS latest FROM events GROUP BY 1")
def latest_change(spark, sf):
    return D.table(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("latest"))


# Lines of text


@query(with_("d") + "SELECT file, line_no, text FROM d WHERE line_no < coalesce((SELECT min(line_no) FROM d AS g WHERE g.file = d.file AND g.text NOT LIKE '%.%'), 1000000000)")
def takewhile_lines(spark, sf):
    return text_lines.take_while(D.lines(spark, sf), F.col("text").contains(".")).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    with_("d", "m AS (SELECT *, right(rtrim(text, ' '), 1) = '.' AS more FROM d)", "g AS (SELECT *, sum(CASE WHEN prev THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line_no) AS grp FROM (SELECT *, coalesce(lag(more) OVER (PARTITION BY file ORDER BY line_no), false) AS prev FROM m))")
    + "SELECT file, min(line_no) AS line_no, string_agg(trim(CASE WHEN more THEN left(rtrim(text, ' '), len(rtrim(text, ' ')) - 1) ELSE text END, ' '), ' ' ORDER BY line_no) AS text, count(*) AS n_lines FROM g GROUP BY file, grp"
)
def continuation_groups(spark, sf):
    return text_lines.continuation_groups(D.lines(spark, sf), ".").withColumn("line_no", F.col("line_no").cast("long"))


def _code(spark, sf):
    """Documents' lines as code: letters i stand for opening braces, o for closing ones, one start in each file."""
    return D.lines(spark, sf).withColumn("text", F.translate("text", "io", "{}"))


_BRACES = "x AS (SELECT file, line_no, translate(text, 'io', '{}') AS text FROM d), w AS (SELECT s.line_no AS start, x.*, len(x.text) - len(replace(x.text, '{', '')) - len(x.text) + len(replace(x.text, '}', '')) AS change, max(CASE WHEN contains(x.text, '{') THEN 1 ELSE 0 END) OVER (PARTITION BY file, s.line_no ORDER BY x.line_no) = 1 AS opened FROM x JOIN (SELECT file, line_no FROM x) AS s USING (file) WHERE x.line_no >= s.line_no), y AS (SELECT *, sum(CASE WHEN opened THEN change ELSE 0 END) OVER (PARTITION BY file, start ORDER BY line_no) AS level FROM w)"


@query(with_("d", _BRACES) + "SELECT file, start, coalesce(min(line_no) FILTER (opened AND level <= 0), start) AS \"end\" FROM y GROUP BY file, start")
def brace_span(spark, sf):
    """Every line as a start."""
    code = _code(spark, sf)
    return text_lines.brace_spans(code, code.select("file", F.col("line_no").alias("start"))).select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(with_("d") + r"SELECT file, line_no AS start, line_no - CASE WHEN regexp_matches(split_part(text, ' ', 1), '^\S*\s*$') THEN 1 ELSE 0 END AS first FROM d")
def return_type_line(spark, sf):
    """Every line as a start."""
    code = D.lines(spark, sf).withColumn("text", F.regexp_replace(F.col("text"), " .*", "("))
    return text_lines.return_type_line(code, code.select("file", F.col("line_no").alias("start"))).select("file", F.col("start").cast("long").alias("start"), F.col("first").cast("long").alias("first"))


@query(with_("d") + r"SELECT file, line_no, trim(text) AS text FROM (SELECT file, line_no, replace(text, 'A ', '#define A ') AS text FROM d) WHERE starts_with(ltrim(text, ' '), '#define')")
def macro_scan(spark, sf):
    lines = D.lines(spark, sf).withColumn("text", F.replace(F.col("text"), F.lit("A "), F.lit("#define A ")))
    return text_lines.macros(lines).select("file", F.col("line_no").cast("long").alias("line_no"), "text")


@query(with_("d", "x AS (SELECT file, line_no * 3 AS line_no, regexp_extract(text, '^(\\w+)', 1) AS name FROM d)") + "SELECT file, name, line_no AS start, line_no + 2 AS \"end\" FROM x WHERE name <> ''")
def struct_scan(spark, sf):
    """Each line's first word as a struct of three lines."""
    name = F.regexp_extract("text", r"^([A-Za-z0-9_]+)", 1)
    made = D.lines(spark, sf).select("file", "line_no", F.posexplode(F.array(F.concat(F.lit("struct "), name, F.lit(" {")), F.lit(" int a;"), F.lit("};"))).alias("k", "text"))
    found = text_lines.struct_definitions(made.select("file", (F.col("line_no") * 3 + F.col("k")).cast("int").alias("line_no"), "text"))
    return found.select("file", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(with_("d") + "SELECT file, line_no, text FROM d WHERE line_no BETWEEN 2 AND 2 + CAST(substr(file, 2) AS BIGINT) % 5")
def line_slice(spark, sf):
    code = D.lines(spark, sf)
    ranges = code.select("file").distinct().select("file", F.lit(2).alias("start"), (F.lit(2) + F.substring(F.col("file"), 2, 20).cast("long") % 5).alias("end"))
    return text_lines.line_slice(code, ranges).select("file", F.col("line_no").cast("long").alias("line_no"), "text")


def _page_lines(spark, sf):
    """Links of pages as include lines, some in angles."""
    links = F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"<>/]+)"'), F.lit(1))).alias("at", "link")
    found = D.table(spark, sf, "pages").select(F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("file"), links)
    text = F.when(F.length("link") % 2 == 0, F.concat(F.lit("#include <"), "link", F.lit(">"))).otherwise(F.concat(F.lit('#include "'), "link", F.lit('"')))
    return found.select("file", (F.col("at") + 1).cast("int").alias("line_no"), text.alias("text"))


_LINKS = "x AS (SELECT 'g' || page_id AS file, regexp_extract_all(html, 'href=\"/([^\"<>/]+)\"', 1) AS links FROM pages), y AS (SELECT file, unnest(links) AS target, unnest(range(1, len(links) + 1)) AS line_no FROM x), i AS (SELECT file, CASE WHEN len(target) % 2 = 0 THEN 'angle' ELSE 'quote' END AS style, target, min(line_no) AS line_no FROM y GROUP BY 1, 2, 3), o AS (SELECT file, style, target, row_number() OVER (PARTITION BY file, style ORDER BY line_no) AS ordinal FROM i)"


@query(with_(_LINKS) + "SELECT file, style, target, ordinal FROM o")
def include_scan(spark, sf):
    return text_lines.includes(_page_lines(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(with_(_LINKS) + "SELECT style, target, row_number() OVER (PARTITION BY style ORDER BY first_at, target) AS position FROM (SELECT style, target, min(row(file, ordinal)) AS first_at FROM o GROUP BY 1, 2)")
def merged_includes(spark, sf):
    return reports.merged_includes(text_lines.includes(_page_lines(spark, sf)), "style").withColumn("position", F.col("position").cast("long"))


@query(with_(_LINKS) + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY place, part) AS line_no, text FROM (SELECT file, CASE style WHEN 'angle' THEN 1 ELSE 2 END AS place, ordinal AS part, CASE style WHEN 'angle' THEN '#include <' || target || '>' ELSE '#include \"' || target || '\"' END AS text FROM o UNION ALL SELECT DISTINCT file, 0, 0, '#ifndef ' || upper(file) FROM o UNION ALL SELECT DISTINCT file, 0, 1, '#define ' || upper(file) FROM o UNION ALL SELECT DISTINCT file, 9, 0, '#endif' FROM o)")
def guarded_includes(spark, sf):
    return rewrite.guarded_includes(text_lines.includes(_page_lines(spark, sf))).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT url, regexp_replace(regexp_replace(url || '/* a ' || chr(10) || ' b */ // c', '/\\*(.|\\n)*?\\*/', '', 'g'), '//[^\\n]*', '', 'g') AS code, upper(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g')) AS guard, regexp_replace(url || chr(10) || '   x', '\\n\\s*', ' ', 'g') AS folded, split_part(url, '/', -1) AS last, CAST(len(url) - len(replace(url, '/', '')) AS BIGINT) AS slashes FROM pages")
def text_functions(spark, sf):
    u = F.col("url")
    long = T.count_of(u, "/").cast("long")
    return D.table(spark, sf, "pages").select("url", T.strip_comments(F.concat(u, F.lit("/* a \n b */ // c"))).alias("code"), T.include_guard(u).alias("guard"), T.fold_lines(F.concat(u, F.lit("\n   x"))).alias("folded"), T.last_segment(u).alias("last"), long.alias("slashes"))


@query(with_("d") + r"SELECT file, line_no, regexp_replace(text, '\bthe\b', 'mod_the', 'g') AS text FROM d")
def rename_symbol(spark, sf):
    return rewrite.rename(D.lines(spark, sf), "the", "mod_the").withColumn("line_no", F.col("line_no").cast("long"))


@query(with_("n") + "SELECT name, 'long ' || name AS return_type, 'int (*a)(int), char b' AS parameters, '{ f(' || name || '); }' AS body, '_' || name || ' x' AS renamed, title || '.c' AS swapped FROM n")
def function_signatures(spark, sf):
    code = F.concat(F.lit("static inline /* c */ long "), "name", F.lit("\n"), F.col("name"), F.lit("x(int (*a)(int), char b) // d\n{ f("), "name", F.lit("); }\n"))
    s = T.signature(code)
    return D.nodes(spark, sf).select("name", F.regexp_replace(s["return_type"], r"\s+", " ").alias("return_type"), s["parameters"].alias("parameters"), s["body"].alias("body"), F.concat(F.lit("_"), "name", F.lit(" x")).alias("renamed"), T.swap_extension(F.concat("title", F.lit(".o")), ".c").alias("swapped"))


@query(with_("n", "x AS (SELECT name, id % 6 AS k, size FROM n)") + "SELECT name, CASE k WHEN 0 THEN 'int' WHEN 1 THEN 'char *' WHEN 2 THEN 'long long []' WHEN 3 THEN 'struct ' || name || ' *' WHEN 4 THEN '' ELSE 'bool * [] []' END AS c_type FROM x")
def c_types(spark, sf):
    k = F.col("id") % 6
    ir = F.when(k == 0, "i32").when(k == 1, "i8*").when(k == 2, F.concat(F.lit("["), F.col("size").cast("string"), F.lit(" x i64]"))).when(k == 3, F.concat(F.lit("%struct."), "name", F.lit("*"))).when(k == 4, "i128").otherwise("[2 x [3 x i1*]]")
    return D.nodes(spark, sf).select("name", T.c_type(ir).alias("c_type"))


_PLACED = "SELECT file, row_number() OVER (PARTITION BY file ORDER BY place) AS line_no, text FROM ({}) ORDER BY 1, 2"


@query(with_("d") + _PLACED.format("SELECT file, line_no::DOUBLE AS place, text FROM d UNION ALL SELECT file, min(line_no) - 0.5, '// new' FROM d WHERE contains(text, ',') GROUP BY file"))
def insert_before_first(spark, sf):
    return rewrite.insert_at_first(D.lines(spark, sf), "// new", ",").withColumn("line_no", F.col("line_no").cast("long"))


@query(with_("d") + _PLACED.format("SELECT file, line_no::DOUBLE AS place, text FROM d UNION ALL SELECT file, coalesce(max(line_no) FILTER (starts_with(ltrim(text, ' '), 'A') OR starts_with(ltrim(text, ' '), 'E')), 0) + 0.5, '// new' FROM d GROUP BY file"))
def insert_after_last(spark, sf):
    return rewrite.insert_after_last(D.lines(spark, sf), "// new", "A", "E").withColumn("line_no", F.col("line_no").cast("long"))


@query(with_("d") + "SELECT file, line_no, text FROM d UNION ALL SELECT file, max(line_no) + 1, '// end' FROM d GROUP BY file")
def append_line(spark, sf):
    return rewrite.append(D.lines(spark, sf), "// end").withColumn("line_no", F.col("line_no").cast("long"))


def _spans(spark, sf):
    return D.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.lit(2).alias("start"), F.lit(4).alias("end"))


_EVEN = "CAST(substr(file, 2) AS BIGINT) % 2 = 0 AND line_no BETWEEN 2 AND 4"


@query(with_("d") + f"SELECT file, line_no, CASE WHEN {_EVEN} THEN '' ELSE text END AS text FROM d")
def blank_range(spark, sf):
    return rewrite.blank_ranges(D.lines(spark, sf), _spans(spark, sf)).withColumn("line_no", F.col("line_no").cast("long"))


@query(with_("d") + f"SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) AS line_no, text FROM d WHERE NOT ({_EVEN})")
def delete_range(spark, sf):
    return rewrite.delete_ranges(D.lines(spark, sf), _spans(spark, sf)).withColumn("line_no", F.col("line_no").cast("long"))


def _code_files(lines):
    """Targets that exist: every fourth document's, with the lines of the next one; some of those are includes and defines."""
    number = F.substring("file", 2, 20).cast("long")
    mark = F.when(F.col("line_no") % 5 == 1, "#include ").when(F.col("line_no") % 7 == 3, "  # define x #define ").otherwise("")
    name = F.concat(F.lit("d"), (number - 1).cast("string"), F.lit("_code.c"))
    return lines.filter(number % 8 == 1).select(name.alias("file"), "line_no", F.concat(F.when(number % 16 == 1, mark).otherwise(""), "text").alias("text"))


def _bodies(spark, sf):
    """Lines 2 to 4 of documents with an even number, and of every sixth from 4 to beyond its end."""
    even = _spans(spark, sf)
    return even.unionByName(even.filter(F.substring("file", 2, 20).cast("long") % 6 == 0).select("file", F.lit(4).alias("start"), F.lit(100_000).alias("end")))


_MOVED = with_(
    "d",
    "c AS (SELECT 'd' || (k - 1) || '_code.c' AS file, line_no, CASE WHEN k % 16 <> 1 THEN '' WHEN line_no % 5 = 1 THEN '#include ' WHEN line_no % 7 = 3 THEN '  # define x #define ' ELSE '' END || text AS text FROM (SELECT *, CAST(substr(file, 2) AS BIGINT) AS k FROM d) WHERE k % 8 = 1)",
    "s AS (SELECT file, k, a, b FROM (SELECT 'd' || doc_id AS file, doc_id AS k FROM documents), (VALUES (2, 4), (4, 100000)) AS r(a, b) WHERE k % 2 = 0 AND (a = 2 OR k % 6 = 0))",
    "w AS (SELECT file || '_code.c' AS file, a, line_no, text FROM d JOIN s USING (file) WHERE line_no BETWEEN a AND b)",
    "h AS (SELECT file, max(line_no) AS head FROM c WHERE contains(text, '#include') OR contains(text, '#define') GROUP BY file)",
    "p AS (SELECT file, line_no::DOUBLE AS place, 0 AS a, 0 AS n, text FROM c UNION ALL SELECT file, coalesce(head, 0) + 0.5, a, line_no, text FROM w LEFT JOIN h USING (file))",
)


@query(_MOVED + "SELECT file, line_no, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.file = d.file AND line_no BETWEEN a AND b) THEN '' ELSE text END AS text FROM d UNION ALL SELECT file, row_number() OVER (PARTITION BY file ORDER BY place, a, n), text FROM p")
def move_bodies(spark, sf):
    code = D.lines(spark, sf)
    return rewrite.move_bodies(code.unionByName(_code_files(code)), _bodies(spark, sf)).withColumn("line_no", F.col("line_no").cast("long"))


@query(with_("d", "g AS (SELECT unnest(range(1, 10001)) AS line_no)") + "SELECT file, line_no, CASE WHEN file = 'd3' AND line_no = 10000 THEN 'x' ELSE text END AS text FROM d UNION ALL SELECT 'd3', line_no, CASE WHEN line_no = 10000 THEN 'x' ELSE '' END FROM g WHERE line_no > (SELECT max(line_no) FROM d WHERE file = 'd3')")
def replace_line(spark, sf):
    return rewrite.replace_line(D.lines(spark, sf), "d3", 10_000, "x").withColumn("line_no", F.col("line_no").cast("long"))


@query(with_("n") + "SELECT name, 'mod_' || name AS new_name, 'INTERFACE(' || name || ')' AS macro, CASE WHEN size % 2 = 0 THEN 'void ' || name || '(int a) { return; }' ELSE 'int ' || name || '(int a) { return -1; }' END AS stub FROM n")
def interface_stubs(spark, sf):
    kind = F.when(F.col("size") % 2 == 0, "void").otherwise("int")
    return rewrite.interface_rows(D.nodes(spark, sf).select("name", kind.alias("return_type"), F.lit("int a").alias("parameters")))


@query(with_("n", "e", "l") + "SELECT name, 'UNEXPORT(' || name || ')' AS text FROM (SELECT DISTINCT dst AS name FROM e WHERE dst NOT IN (SELECT name FROM l WHERE label = 'EXPORT') AND dst NOT IN (SELECT name FROM n WHERE brand = 'Brand#2'))")
def unexport_rows(spark, sf):
    return rewrite.symbol_rows(unexported_symbols(spark, sf), "UNEXPORT")


@query(with_(_LINKS, "z AS (SELECT file, line_no, CASE WHEN len(target) % 2 = 0 THEN '#include <' || target || '>' ELSE '#include \"' || target || '\"' END AS text FROM y)") + _PLACED.format("SELECT file, line_no::DOUBLE AS place, text FROM z UNION ALL SELECT DISTINCT file, 0.5, '#include <linux/module.h>' FROM z WHERE CAST(substr(file, 2) AS BIGINT) % 2 = 0"))
def module_include(spark, sf):
    lines = _page_lines(spark, sf)
    return rewrite.module_include(lines, lines.filter(F.substring(F.col("file"), 2, 20).cast("long") % 2 == 0)).withColumn("line_no", F.col("line_no").cast("long"))


@query(with_("d") + f"SELECT file, 'f' AS name, string_agg(text, chr(10) ORDER BY line_no) AS body, regexp_matches(string_agg(text, chr(10) ORDER BY line_no), '\\bthe\\b') AS inline FROM d WHERE {_EVEN} GROUP BY 1")
def inline_bodies(spark, sf):
    found = rewrite.inline_bodies(D.lines(spark, sf), _spans(spark, sf).withColumn("name", F.lit("f")))
    return found.select("file", "name", "body", N.inline_or_unknown(N.has_inline(F.regexp_replace("body", r"\bthe\b", "inline"))).alias("inline"))


# Compiler facts: functions are parts, an order's lines are operands of the first one's instructions


def _facts(spark, sf):
    items = D.table(spark, sf, "lineitem").filter("l_linenumber in (1, 2, 3)")
    module, part = F.concat(F.lit("m/"), (F.col("l_orderkey") % 50).cast("string"), F.lit("-x.c")), D.part_name(F.col("l_partkey"))
    kind = F.when(F.col("l_linenumber") == 1, "func").when(F.col("l_linenumber") == 2, "gv").otherwise("const")
    target = F.when(F.col("l_linenumber") == 1, part).when(F.col("l_linenumber") == 2, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")))
    operands = items.select(module.alias("module"), D.part_name(F.col("l_orderkey") % 100).alias("func"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("idx"), kind.alias("kind"), target.alias("target"))
    n = spark.range(50).select(F.concat(F.lit("m/"), F.col("id").cast("string"), F.lit("-x.c")).alias("module"))
    c = n.select("module", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    constants = c.select("module", F.concat(F.lit("c"), F.col("k").cast("string")).alias("id"), F.when(F.col("k") % 2 == 0, "const").otherwise("func").alias("kind"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("c"), (F.col("k") + 1).cast("string"))).otherwise(D.part_name(F.col("k"))).alias("target"))
    return operands, constants


_FACTS = "o AS (SELECT 'm/' || (l_orderkey % 50) || '-x.c' AS module, 'p' || (l_orderkey % 100) AS func, CASE l_linenumber WHEN 1 THEN 'p' || l_partkey WHEN 2 THEN '__virtual__global__s' || l_suppkey ELSE 'p' || (l_partkey % 40 + CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END) END AS target, l_linenumber AS k FROM lineitem WHERE l_linenumber IN (1, 2, 3))"
_NO_ALIAS = "module string, alias string, kind string, target string"


@query(with_(_FACTS) + "SELECT DISTINCT module, func AS src, target AS dst FROM o WHERE k = 1")
def ir_call_edges(spark, sf):
    operands, _ = _facts(spark, sf)
    instructions = operands.select("module", "func", "seq", F.lit("call").alias("opcode")).distinct()
    return facts.call_edges(operands, instructions)


@query(with_(_FACTS) + "SELECT DISTINCT replace(replace(replace(module, '/', '_'), '-', '_'), '.', '_') || '__virtual_init' AS src, target AS dst FROM o WHERE k IN (1, 3)")
def ir_initialiser_edges(spark, sf):
    operands, constants = _facts(spark, sf)
    return facts.initialiser_edges(operands.select("module", F.col("func").alias("gv"), "kind", "target"), constants, spark.createDataFrame([], _NO_ALIAS))


@query(with_(_FACTS) + "SELECT DISTINCT func AS src, target AS dst FROM o WHERE k = 2 UNION SELECT DISTINCT '__virtual__global__' || func, target FROM o")
def ir_global_edges(spark, sf):
    operands, constants = _facts(spark, sf)
    return facts.global_edges(operands, operands.select("module", F.col("func").alias("gv"), "kind", "target"), constants, spark.createDataFrame([], _NO_ALIAS))


@query(with_("n", "e", "q AS (SELECT name AS value, 'f' || id AS func FROM n WHERE size = 1)", "r(value, func) AS (SELECT value, func FROM q UNION SELECT dst, func FROM r JOIN e ON src = value)", recursive=True) + "SELECT value, func FROM r")
def ir_points_to(spark, sf):
    taken = D.nodes(spark, sf).filter("size = 1").select(F.col("name").alias("value"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("func"))
    return facts.points_to(D.edges(spark, sf), taken)


@query(with_("n", "e", "q AS (SELECT name AS value, 'f' || (id % 20) AS func FROM n)") + "SELECT e.src, q.func AS dst FROM e JOIN q ON q.value = e.dst UNION SELECT q.func, p.func FROM e JOIN q ON q.value = e.dst JOIN q AS p ON p.value = e.src")
def ir_indirect_edges(spark, sf):
    pointing = D.nodes(spark, sf).select(F.col("name").alias("value"), F.concat(F.lit("f"), (F.col("id") % 20).cast("string")).alias("func"))
    calls = D.edges(spark, sf).select(F.col("src").alias("caller"), F.col("dst").alias("value"))
    return facts.indirect_edges(calls, calls.withColumn("arg", F.col("caller")), pointing)


@query(with_("n", "e", "q AS (SELECT name || CASE WHEN id % 4 = 0 THEN '@isDeclaration' ELSE '@isDefinition' END AS tagged, name FROM n)") + "SELECT 'm' AS module, q.tagged || ' -> ' || coalesce(string_agg(p.tagged, ' ' ORDER BY p.tagged), '') AS text FROM q LEFT JOIN e ON e.src = q.name LEFT JOIN q AS p ON p.name = e.dst GROUP BY q.tagged")
def ir_adjacency_text(spark, sf):
    functions = D.nodes(spark, sf).select(F.lit("m").alias("module"), "name", (F.col("id") % 4 == 0).alias("is_decl"))
    return facts.adjacency_text(functions, D.edges(spark, sf).withColumn("module", F.lit("m")))


@query(with_("o", "i", "u", "l AS (SELECT module, func, target AS result FROM u WHERE opcode = 'load' AND idx = 0 AND kind = 'local')") + "SELECT module, func AS src, target AS dst FROM u WHERE kind = 'func' AND (opcode IN ('call', 'invoke', 'phi') OR opcode = 'store' AND idx = 0) UNION SELECT l.module, l.func, u.target FROM l JOIN u ON u.module = l.module AND u.func = l.func AND CAST(u.seq AS VARCHAR) = result AND opcode IN ('call', 'invoke') AND idx = 0 AND kind = 'func'")
def ir_program_calls(spark, sf):
    """Calls, functions stored, merged or passed, and calls whose result is loaded."""
    operands, instructions, _, _ = D.program(spark, sf)
    return facts.call_edges(operands, instructions)


@query(with_("o", "x", "z AS (SELECT func, coalesce(x.kind, o.kind) AS kind, coalesce(x.target, o.target) AS name FROM o LEFT JOIN x ON node = o.target AND o.kind IN ('const', 'alias'))") + "SELECT DISTINCT func, name, CASE WHEN CAST(substr(name, 2) AS BIGINT) % 3 > 0 THEN 'src/' || name || '.c' END AS file FROM z WHERE kind = 'func'")
def ir_used_functions(spark, sf):
    operands, _, constants, aliases = D.program(spark, sf)
    declared = spark.range(200).filter("id % 3 > 0").select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("name")).withColumn("file", F.concat(F.lit("src/"), "name", F.lit(".c")))
    return facts.used_functions(operands, constants, aliases, declared)


@query(with_("o", "x", "z AS (SELECT func, coalesce(x.kind, o.kind) AS kind, coalesce(x.target, o.target) AS name FROM o LEFT JOIN x ON node = o.target AND o.kind IN ('const', 'alias'))") + "SELECT DISTINCT func, name, CASE CAST(substr(name, 2) AS BIGINT) % 3 WHEN 0 THEN 'int []' WHEN 1 THEN 'struct ' || name || ' *' ELSE 'char' END AS c_type FROM z JOIN supplier ON s_suppkey = CAST(substr(name, 2) AS BIGINT) WHERE kind = 'gv' UNION SELECT DISTINCT func, name, NULL FROM z WHERE kind = 'gv' AND CAST(substr(name, 2) AS BIGINT) NOT IN (SELECT s_suppkey FROM supplier)")
def ir_used_globals(spark, sf):
    operands, _, constants, aliases = D.program(spark, sf)
    k, name = F.col("s_suppkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    types = D.table(spark, sf, "supplier").select(name.alias("name"), F.when(k % 3 == 0, "[4 x i32]").when(k % 3 == 1, F.concat(F.lit("%struct."), name, F.lit("*"))).otherwise("i8").alias("type"))
    return facts.used_globals(operands, constants, aliases, types)


_VALUE = "CASE kind WHEN 'local' THEN module || chr(9) || func || chr(9) || kind || chr(9) || target ELSE module || chr(9) || kind || chr(9) || target END"
_RESULT = "module || chr(9) || func || chr(9) || 'local' || chr(9) || seq"
_POINTING = (
    f"w AS (SELECT *, {_VALUE} AS value, {_RESULT} AS result FROM u)",
    "st AS (SELECT a.module, a.func, a.kind, a.target, a.value, b.value AS pointer, b.kind AS p_kind, b.target AS p_target FROM w AS a JOIN w AS b ON a.module = b.module AND a.func = b.func AND a.seq = b.seq WHERE a.opcode = 'store' AND a.idx = 0 AND b.idx = 1)",
    f"tk AS (SELECT func AS src, unnest([value, pointer]) AS value, target AS f FROM st WHERE kind = 'func' UNION SELECT func, unnest([{_RESULT}, module || chr(9) || 'func' || chr(9) || leaf_target]), leaf_target FROM v WHERE opcode NOT IN ('call', 'invoke', 'store') AND leaf = 'func')",
    "cp AS (SELECT value AS a, pointer AS b FROM st UNION SELECT result, value FROM w WHERE opcode IN ('call', 'invoke') AND idx > 0 AND is_pointer)",
    "pt(value, f) AS (SELECT value, f FROM tk UNION SELECT b, f FROM pt JOIN cp ON a = value)",
)


@query(with_("o", "i", "x", "u", "v", *_POINTING, recursive=True) + "SELECT value, f AS func FROM pt")
def ir_pointing_values(spark, sf):
    """Addresses taken by stores and other instructions, through stores and into the pointer arguments of calls."""
    operands, instructions, constants, aliases = D.program(spark, sf)
    taken = facts.taken_functions(operands, instructions, constants, aliases)
    return facts.points_to(facts.copies(operands, instructions), taken)


_CLASSES = (*_POINTING[:4], "vl AS (SELECT value FROM tk UNION SELECT a FROM cp UNION SELECT b FROM cp)", "un(value, other) AS (SELECT value, value FROM vl UNION SELECT un.value, j.y FROM un JOIN (SELECT a AS x, b AS y FROM cp UNION SELECT b, a FROM cp) AS j ON j.x = un.other)", "cl AS (SELECT value, min(other) AS class FROM un GROUP BY value)")


@query(with_("o", "i", "x", "u", "v", *_CLASSES, recursive=True) + "SELECT value, class FROM cl")
def ir_value_classes(spark, sf):
    """Values that unification takes for one."""
    return facts.value_classes(*D.program(spark, sf))[0]


@query(with_("o", "i", "x", "u", "v", *_CLASSES, recursive=True) + "SELECT DISTINCT class, f AS func FROM cl JOIN tk USING (value)")
def ir_class_functions(spark, sf):
    """What the values of a class may point at: one row a class and function, whatever the number of values."""
    return facts.value_classes(*D.program(spark, sf))[1]


@query(
    with_("o", "i", "x", "u", "v", *_POINTING, "ce AS (SELECT module, func, seq, target AS callee FROM w WHERE opcode IN ('call', 'invoke') AND idx = 0 AND kind = 'func' UNION SELECT module, func, seq, f FROM w JOIN pt USING (value) WHERE opcode IN ('call', 'invoke') AND idx = 0 AND kind <> 'func')", "pa AS (SELECT module, func, seq, f AS passed FROM w JOIN pt USING (value) WHERE opcode IN ('call', 'invoke') AND idx > 0)", "ga AS (SELECT 'a' || k AS alias, 's' || k AS gv FROM (SELECT unnest(range(0, 30)) AS k) WHERE k % 3 = 2)", recursive=True)
    + "SELECT func AS src, callee AS dst FROM ce UNION SELECT callee, passed FROM ce JOIN pa USING (module, func, seq) WHERE callee <> passed UNION SELECT src, f FROM tk UNION SELECT '__virtual__global__' || coalesce(gv, p_target), f FROM st JOIN pt USING (value) LEFT JOIN ga ON alias = p_target AND p_kind = 'alias' WHERE p_kind = 'gv' OR gv IS NOT NULL"
)
def ir_program_edges(spark, sf):
    """All edges that the instructions imply."""
    return facts.program_edges(*D.program(spark, sf))


@query(with_("n") + "SELECT DISTINCT title AS name, file FROM n WHERE id % 4 > 0 AND size % 2 = 0")
def global_locations(spark, sf):
    n = D.nodes(spark, sf)
    return graphs.global_locations(n.select(F.col("title").alias("name"), F.when(F.col("id") % 4 > 0, F.col("file")).alias("file"), (F.col("size") % 2 == 0).alias("has_initialiser")))


@query(with_("n") + "SELECT brand AS func, arg_min(file, row(name, size, file)) AS file, arg_min(size, row(name, size, file)) AS line FROM n GROUP BY brand")
def function_locations(spark, sf):
    """The first of the places that a name is at."""
    return graphs.function_locations(D.nodes(spark, sf).select(F.col("name").alias("module"), F.col("brand").alias("func"), "file", F.col("size").alias("line")))


@query(with_("d", "w AS (SELECT DISTINCT file, 'g' || (CAST(substr(file, 2) AS BIGINT) % 7) AS name FROM d)", "p AS (SELECT file, line_no::DOUBLE AS place, 0 AS part, text FROM d UNION ALL SELECT file, max(line_no) + 0.5, 1, '#include <linux/export.h>' FROM d GROUP BY file UNION ALL SELECT w.file, max(line_no) + 0.5, 2, 'EXPORT_SYMBOL(' || name || ');' FROM d JOIN w USING (file) GROUP BY w.file, name)") + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY place, part) AS line_no, text FROM p")
def export_macros(spark, sf):
    lines = D.lines(spark, sf)
    wanted = lines.select("file").distinct().withColumn("name", F.concat(F.lit("g"), (F.substring(F.col("file"), 2, 20).cast("long") % 7).cast("string")))
    return rewrite.export_macros(lines, wanted).withColumn("line_no", F.col("line_no").cast("long"))


@query(with_("n", "l", "t") + "SELECT name, type FROM (SELECT name, CASE WHEN id % 6 = 0 THEN 'VIRTUAL' ELSE type END AS type FROM t JOIN n USING (name)) WHERE type <> 'VIRTUAL'")
def drop_virtual(spark, sf):
    typed = _typed(spark, sf).withColumn("type", F.when(F.substring(F.col("name"), 2, 20).cast("long") % 6 == 0, "VIRTUAL").otherwise(F.col("type")))
    return graph.without_virtual(typed).select("name", "type")
