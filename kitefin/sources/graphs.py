"""Scans of call graphs: adjacency text, DOT files, attribute and edge patterns, symbol tables, debug info."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_name, is_intrinsic, is_syscall, strip_tag
from .text_lines import take_while

DEFINED = "isDefinition"


def adjacency(lines: DataFrame, points_to: bool = False, strict_names: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes(file, name), edges(file, src, dst)) of `caller@tag -> callee@tag ...` lines (file, line_no, text).

    Files are read up to their first line without an arrow. Callers only have word characters unless strict_names is
    off. Edges keep duplicates; of points-to text a line's callees are distinct and compiler intrinsics are dropped.
    """
    kept = take_while(lines, F.col("text").contains("->"))
    pattern = r"([\w@]+) -> (.*)" if strict_names else r"(\S+) -> (.*)"
    head, rest = F.regexp_extract("text", "^" + pattern, 1), F.regexp_extract("text", "^" + pattern, 2)
    parsed = kept.select("file", head.alias("head"), F.filter(F.split(rest, r"\s+"), lambda t: t != "").alias("callees")).filter("head <> ''")
    parsed = parsed.withColumn("src", strip_tag(F.col("head"))).withColumn("tag", F.substring_index("head", "@", -1))
    if points_to:
        parsed = parsed.filter(~is_intrinsic(F.col("src"))).withColumn("callees", F.filter(F.array_distinct("callees"), lambda t: ~is_intrinsic(t)))
    nodes = parsed.filter(F.col("tag") == DEFINED).select("file", F.col("src").alias("name")).distinct()
    edges = parsed.select("file", "src", F.explode("callees").alias("callee")).select("file", "src", strip_tag(F.col("callee")).alias("dst"))
    return nodes, edges


_NAME = r'("[^"]*"|[\w.$]+)'


def dot(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(name, file, type, recommendation), edges(src, dst)) of DOT text; a node named by a line break is dropped."""
    text = F.trim("text")
    edge = rf"^{_NAME}\s*->\s*{_NAME}"
    edges = lines.filter(text.rlike(edge)).select(clean_name(F.regexp_extract(text, edge, 1)).alias("src"), clean_name(F.regexp_extract(text, edge, 2)).alias("dst"))
    node = rf"^{_NAME}\s*(\[.*\])?\s*;?$"
    attribute = lambda k: F.nullif(F.regexp_extract(text, rf'\b{k}="?([^",\]]*)"?', 1), F.lit(""))
    nodes = lines.filter(text.rlike(node) & ~text.rlike(r"^(node|edge|graph)\s*(\[|;|$)")).select(clean_name(F.regexp_extract(text, node, 1)).alias("name"), *(attribute(k).alias(k) for k in ("file", "type", "recommendation")))
    return nodes.filter(~F.col("name").isin("\\n", "\n")), edges


def render_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (text) of a DOT body: a line a node with what attributes it has, a line an edge."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    have = [c for c in ("file", "type", "recommendation", "fillcolor") if c in nodes.columns]
    attributes = F.concat_ws(", ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c}="'), F.col(c), F.lit('"'))) for c in have))
    node = F.concat(quoted(F.col("name")), F.when(attributes != "", F.concat(F.lit(" ["), attributes, F.lit("]"))).otherwise(""), F.lit(";"))
    return nodes.select(node.alias("text")).unionAll(edges.select(F.concat(quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(";"))))


def file_attributes(lines: DataFrame) -> DataFrame:
    """name -> file of lines like `name [file="..."]`; the last line of a name wins."""
    # Fixed value: the line format of the attribute file.
    pattern = r'^(.*?)\s*\[file="(.*?)"(.*?)\]'
    found = lines.select("line_no", clean_name(F.trim(F.regexp_extract("text", pattern, 1))).alias("name"), F.regexp_extract("text", pattern, 2).alias("path"))
    return found.filter("name <> ''").groupBy("name").agg(F.max_by("path", "line_no").alias("file"))


def identifier_edges(lines: DataFrame) -> DataFrame:
    """Distinct (src, dst) of lines like `a -> b`, of C identifiers only."""
    # Fixed value: the line format of edges between identifiers.
    pattern = r'"?\b([a-zA-Z_]\w*)\b"?\s*->\s*"?\b([a-zA-Z_]\w*)\b"?'
    return lines.select(F.regexp_extract("text", pattern, 1).alias("src"), F.regexp_extract("text", pattern, 2).alias("dst")).filter("src <> ''").distinct()


def classify_symbols(symbols: DataFrame) -> DataFrame:
    """(label, name) of ELF symbols (file, name, section); only files with both an init and an export section count."""
    init, export = F.col("section") == ".init.text", F.col("section") == "__ksymtab_strings"
    whole = symbols.groupBy("file").agg(F.max(init).alias("i"), F.max(export).alias("e")).filter("i and e").select("file")
    kept = symbols.join(whole, "file", "left_semi")
    name = F.col("name")
    labels = F.array_compact(
        F.array(
            F.when(init, F.struct(F.lit("INIT").alias("label"), name.alias("name"))),
            F.when(export & name.contains("__kstrtab_"), F.struct(F.lit("EXPORT").alias("label"), F.replace(name, F.lit("__kstrtab_"), F.lit("")).alias("name"))),
            F.when((F.col("section") == ".text") & name.contains("trace"), F.struct(F.lit("TRACE").alias("label"), name.alias("name"))),
            F.when(is_syscall(name) & ~name.startswith("__do_compat_sys"), F.struct(F.lit("SYSCALL").alias("label"), name.alias("name"))),
        )
    )
    return kept.select(F.explode(labels).alias("l")).select("l.label", "l.name").distinct()


def debug_locations(lines: DataFrame, root: str) -> DataFrame:
    """func, file, line of disassembly (file, line_no, text): `define ... @f ... !dbg !N`, then metadata by number."""
    number = F.regexp_extract("text", r"^!(\d+) = ", 1)
    metadata = lines.select("file", number.alias("id"), "text").filter("id <> ''")
    defines = lines.select(F.col("file").alias("module"), F.regexp_extract("text", r"^define .*@([\w.$]+)\(", 1).alias("func"), F.regexp_extract("text", r"!dbg !(\d+)", 1).alias("dbg")).filter("func <> '' and dbg <> ''")
    program = metadata.select(F.col("file").alias("p_module"), F.col("id").alias("p_id"), F.regexp_extract("text", r"file: !(\d+)", 1).alias("file_id"), F.regexp_extract("text", r"line: (\d+)", 1).cast("int").alias("line"))
    files = metadata.select(F.col("file").alias("f_module"), F.col("id").alias("f_id"), F.regexp_extract("text", r'filename: "([^"]*)"', 1).alias("filename"), F.regexp_extract("text", r'directory: "([^"]*)"', 1).alias("directory"))
    joined = defines.join(program, (F.col("module") == F.col("p_module")) & (F.col("dbg") == F.col("p_id"))).join(files, (F.col("module") == F.col("f_module")) & (F.col("file_id") == F.col("f_id")))
    path = F.concat_ws("/", F.nullif("directory", F.lit("")), "filename")
    return joined.select("module", "func", F.substring_index(path, root, -1).alias("file"), "line")


def function_locations(located: DataFrame) -> DataFrame:
    """func, file, line of each name's first location (module, func, file, line), by module, then line."""
    first = located.groupBy("func").agg(F.min(F.struct("module", "line", "file")).alias("at"))
    return first.select("func", "at.file", "at.line")


def global_locations(facts: DataFrame) -> DataFrame:
    """name, file of globals that have debug information and an initialiser, from facts (name, file, has_initialiser)."""
    return facts.filter("file is not null and has_initialiser").select("name", "file").distinct()
