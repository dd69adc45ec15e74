"""Deterministic graphs and line tables derived from the star-schema tables, and the same as SQL for oracles.

Graph A: parts are functions, in files two directories deep; a call leads from one part of an order to the next.
Graph B: suppliers are global variables that functions use and that point at functions and at one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import GLOBAL_PREFIX
from ..shared import by_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_name(c) -> F.Column:
    return F.concat(F.lit("p"), c.cast("string"))


def global_name(c) -> F.Column:
    return F.concat(F.lit(GLOBAL_PREFIX + "s"), c.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, file, id, size, title, brand."""
    file = F.concat(F.lit("/"), "p_type", F.lit("/"), "p_brand", F.lit("/f"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "part").select(part_name(F.col("p_partkey")).alias("name"), file.alias("file"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))


def _chain(rows: DataFrame, column: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", column)
    return rows.select(F.col(column).alias("a"), F.lead(column).over(order).alias("b")).filter("b is not null").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(table(spark, sf_dir, "lineitem").filter("l_linenumber = 7"), "l_partkey").select(part_name(F.col("a")).alias("src"), part_name(F.col("b")).alias("dst"))


def whole_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph A of all lines of an order."""
    return _chain(table(spark, sf_dir, "lineitem"), "l_partkey").select(part_name(F.col("a")).alias("src"), part_name(F.col("b")).alias("dst"))


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the file of their caller."""
    return edges(spark, sf_dir).join(by_key(nodes(spark, sf_dir).select(F.col("name").alias("src"), "file")), "src").select("file", "src", "dst")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, title, brand = F.col("size"), F.col("title"), F.col("brand")
    rules = {
        "INIT": size == 1,
        "EXPORT": size % 7 == 0,
        "TRACE": title.contains("ring") & (size % 5 == 0),
        "SYSCALL": size == 3,
        "MODULAR": brand == "Brand#5",
        "VIRTUAL_STRUCTS": size == 11,
        "USE_TRACE_SYSCALL": size == 17,
        "VIRTUAL_STRUCTS_REACH_TOP": size == 13,
        "INLINE": size % 3 == 0,
    }
    held = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return nodes(spark, sf_dir).select(F.explode(held).alias("label"), "name")


def global_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, src, dst of graph B: func -> gv, gv -> func, gv -> gv; a global's edges are in every file of its nation."""
    items = table(spark, sf_dir, "lineitem")
    files = nodes(spark, sf_dir).select(F.col("id").alias("l_partkey"), "file")
    uses = items.filter("l_linenumber = 5 and l_returnflag = 'R'").join(by_key(files), "l_partkey").select("file", part_name(F.col("l_partkey")).alias("src"), global_name(F.col("l_suppkey")).alias("dst"))
    points = items.filter("l_linenumber = 6 and l_returnflag = 'A'").join(by_key(files), "l_partkey").select("file", global_name(F.col("l_suppkey")).alias("src"), part_name(F.col("l_partkey")).alias("dst"))
    inner = _chain(items.filter("l_discount >= 0.10 and l_returnflag = 'A'"), "l_suppkey").select("a", "b")
    loops = table(spark, sf_dir, "supplier").filter("s_suppkey % 17 = 0").select(F.col("s_suppkey").alias("a"), F.col("s_suppkey").alias("b"))
    between = inner.unionByName(loops).select(F.lit("/ECONOMY/Brand#1/f0").alias("file"), global_name(F.col("a")).alias("src"), global_name(F.col("b")).alias("dst"))
    return uses.unionByName(points).unionByName(between).distinct()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: file, line_no, text."""
    split = F.posexplode(F.split("text", "\n")).alias("at", "text")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), split).select("file", (F.col("at") + 1).cast("int").alias("line_no"), "text")


def adjacency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph A as adjacency text: a line a function, some files broken off by a line without an arrow."""
    tag = lambda name, number: F.concat(name, F.when(number % 4 == 0, "@isDeclaration").otherwise("@isDefinition"))
    n = nodes(spark, sf_dir)
    number = F.substring(F.col("dst"), 2, 20).cast("long")
    callees = edges(spark, sf_dir).groupBy("src").agg(F.concat_ws(" ", F.sort_array(F.collect_list(tag(F.col("dst"), number)))).alias("callees"))
    whole = n.join(callees.withColumnRenamed("src", "name"), "name", "left")
    intrinsic = F.when(F.col("id") % 3 == 0, " llvm.dbg.value llvm.dbg.value").otherwise("")
    said = F.concat(tag(F.col("name"), F.col("id")), F.lit(" -> "), F.coalesce("callees", F.lit("")), intrinsic, F.lit(" "))
    text = F.when(F.col("id") % 50 == 7, "(garbage)").when(F.col("id") % 50 == 9, F.concat(F.lit("x."), said)).otherwise(said)
    return whole.select("file", F.row_number().over(Window.partitionBy("file").orderBy("id")).alias("line_no"), text.alias("text"))


def program(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """operands, instructions, constants, aliases: an order is an instruction, its lines are operands of all kinds.

    Constants hold constants, functions or globals, aliases other aliases, functions or globals; locals are results of
    other orders.
    """
    items = table(spark, sf_dir, "lineitem")
    order, part, s = F.col("l_orderkey"), F.col("l_partkey"), lambda c: c.cast("string")
    module, func = F.concat(F.lit("m"), s(order % 5)), F.concat(F.lit("f"), s(order % 60))
    name = lambda letter, c: F.concat(F.lit(letter), s(c))
    pick = part % 5
    kind = F.when(pick == 0, "func").when(pick == 1, "gv").when(pick == 2, "const").when(pick == 3, "alias").otherwise("local")
    target = F.when(pick == 0, name("g", part % 200)).when(pick == 1, name("s", F.col("l_suppkey"))).when(pick == 2, name("c", part % 40)).when(pick == 3, name("a", part % 30)).otherwise(s(part % 300))
    operands = items.select(module.alias("module"), func.alias("func"), order.alias("seq"), (F.col("l_linenumber") - 1).alias("idx"), kind.alias("kind"), target.alias("target"), (F.col("l_suppkey") % 2 == 0).alias("is_pointer"))
    code = F.when(order % 6 == 0, "call").when(order % 6 == 1, "store").when(order % 6 == 2, "phi").when(order % 6 == 3, "load").when(order % 6 == 4, "invoke").otherwise("bitcast")
    instructions = table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), s(F.col("o_orderkey") % 5)).alias("module"), F.concat(F.lit("f"), s(F.col("o_orderkey") % 60)).alias("func"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("l_orderkey")).withColumn("opcode", code).drop("l_orderkey")
    m, k = spark.range(5).select(F.concat(F.lit("m"), s(F.col("id"))).alias("module")), F.col("k")
    inside = lambda n, letter, same: m.select("module", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select(
        "module", name(letter, k).alias("node"), F.when(k % 3 == 0, same).when(k % 3 == 1, "func").otherwise("gv").alias("kind"), F.when(k % 3 == 0, name(letter, k + 1)).when(k % 3 == 1, name("g", k)).otherwise(name("s", k)).alias("target")
    )
    return operands, instructions, inside(40, "c", "const").withColumnRenamed("node", "id"), inside(30, "a", "alias").withColumnRenamed("node", "alias")


#: The same as SQL: common table expressions n, e, fe, l, b, d, a; i, o, x, u, v of the program. whole_e is e of all lines.
SQL = {
    "n": "n AS (SELECT 'p' || p_partkey AS name, '/' || p_type || '/' || p_brand || '/f' || (p_partkey % 10) AS file, p_partkey AS id, p_size AS size, p_name AS title, p_brand AS brand FROM part)",
    "e": "e AS (SELECT DISTINCT 'p' || x AS src, 'p' || y AS dst FROM (SELECT l_partkey AS x, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) AS y FROM lineitem WHERE l_linenumber = 7) WHERE y IS NOT NULL)",
    "whole_e": "e AS (SELECT DISTINCT 'p' || x AS src, 'p' || y AS dst FROM (SELECT l_partkey AS x, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) AS y FROM lineitem) WHERE y IS NOT NULL)",
    "fe": "fe AS (SELECT file, src, dst FROM e JOIN n ON src = name)",
    "l": "l AS (SELECT unnest(list_filter([CASE WHEN size = 1 THEN 'INIT' END, CASE WHEN size % 7 = 0 THEN 'EXPORT' END, CASE WHEN title LIKE '%ring%' AND size % 5 = 0 THEN 'TRACE' END, CASE WHEN size = 3 THEN 'SYSCALL' END, CASE WHEN brand = 'Brand#5' THEN 'MODULAR' END, CASE WHEN size = 11 THEN 'VIRTUAL_STRUCTS' END, CASE WHEN size = 17 THEN 'USE_TRACE_SYSCALL' END, CASE WHEN size = 13 THEN 'VIRTUAL_STRUCTS_REACH_TOP' END, CASE WHEN size % 3 = 0 THEN 'INLINE' END], lambda x: x IS NOT NULL)) AS label, name FROM n)",
    "t": "t AS (SELECT name, file, coalesce((SELECT arg_min(label, list_position(['INIT', 'INIT_REACH', 'SYSCALL', 'TRACE', 'EXPORT', 'MODULAR', 'VIRTUAL_STRUCTS', 'USE_TRACE_SYSCALL', 'VIRTUAL_STRUCTS_REACH_TOP'], label)) FROM l WHERE l.name = n.name AND label <> 'INLINE'), 'PLAIN') AS type FROM n)",
    "b": "b AS (SELECT file, 'p' || l_partkey AS src, '__virtual__global__s' || l_suppkey AS dst FROM lineitem JOIN n ON id = l_partkey WHERE l_linenumber = 5 AND l_returnflag = 'R' UNION SELECT file, '__virtual__global__s' || l_suppkey, 'p' || l_partkey FROM lineitem JOIN n ON id = l_partkey WHERE l_linenumber = 6 AND l_returnflag = 'A' UNION SELECT '/ECONOMY/Brand#1/f0', '__virtual__global__s' || x, '__virtual__global__s' || y FROM (SELECT l_suppkey AS x, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_suppkey) AS y FROM lineitem WHERE l_discount >= 0.10 AND l_returnflag = 'A' UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 17 = 0) WHERE y IS NOT NULL)",
    "d": "d AS (SELECT 'd' || doc_id AS file, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents)",
    "i": "i AS (SELECT 'm' || (o_orderkey % 5) AS module, 'f' || (o_orderkey % 60) AS func, o_orderkey AS seq, ['call', 'store', 'phi', 'load', 'invoke', 'bitcast'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS opcode FROM orders)",
    "o": "o AS (SELECT 'm' || (l_orderkey % 5) AS module, 'f' || (l_orderkey % 60) AS func, l_orderkey AS seq, l_linenumber - 1 AS idx, ['func', 'gv', 'const', 'alias', 'local'][CAST(l_partkey % 5 AS INTEGER) + 1] AS kind, CASE l_partkey % 5 WHEN 0 THEN 'g' || (l_partkey % 200) WHEN 1 THEN 's' || l_suppkey WHEN 2 THEN 'c' || (l_partkey % 40) WHEN 3 THEN 'a' || (l_partkey % 30) ELSE CAST(l_partkey % 300 AS VARCHAR) END AS target, l_suppkey % 2 = 0 AS is_pointer FROM lineitem)",
    # What a constant or an alias leads to: number k of three in a row holds number k + 1, a function, a global.
    "x": "x AS (SELECT letter || k AS node, kind, target FROM (SELECT letter, k, CASE k % 3 WHEN 2 THEN 'gv' ELSE 'func' END AS kind, CASE k % 3 WHEN 0 THEN 'g' || (k + 1) WHEN 1 THEN 'g' || k ELSE 's' || k END AS target, k % 3 = 0 AND k + 1 >= n AS ends FROM (SELECT 'c' AS letter, 40 AS n, unnest(range(0, 40)) AS k UNION ALL SELECT 'a', 30, unnest(range(0, 30)))) WHERE NOT ends)",
    "u": "u AS (SELECT o.*, opcode FROM o JOIN i USING (module, func, seq))",
    "v": "v AS (SELECT u.*, coalesce(x.kind, u.kind) AS leaf, coalesce(x.target, u.target) AS leaf_target FROM u LEFT JOIN x ON node = u.target AND u.kind IN ('const', 'alias') WHERE u.kind <> 'local' AND (node IS NOT NULL OR u.kind NOT IN ('const', 'alias')))",
    "a": "a AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY id) AS line_no, CASE WHEN id % 50 = 7 THEN '(garbage)' ELSE CASE WHEN id % 50 = 9 THEN 'x.' ELSE '' END || name || CASE WHEN id % 4 = 0 THEN '@isDeclaration' ELSE '@isDefinition' END || ' -> ' || coalesce((SELECT string_agg(dst || CASE WHEN CAST(substr(dst, 2) AS BIGINT) % 4 = 0 THEN '@isDeclaration' ELSE '@isDefinition' END, ' ') FROM e WHERE src = name), '') || CASE WHEN id % 3 = 0 THEN ' llvm.dbg.value llvm.dbg.value' ELSE '' END || ' ' END AS text FROM n)",
}


def with_(*parts: str, recursive: bool = False) -> str:
    """`WITH` the named expressions; other parts are expressions themselves."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL.get(p, p) for p in parts) + " "
