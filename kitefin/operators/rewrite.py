"""Source rewriting as functions from line tables (file, line_no, text) to line tables: nothing is edited in place.

New lines get a place between their neighbours', and lines are numbered anew by a window over each file.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import include_guard, rename_word
from ..sources.text_lines import covered, line_slice


def renumber(placed: DataFrame) -> DataFrame:
    """Lines numbered from 1 by `place`, then `part`."""
    order = Window.partitionBy("file").orderBy("place", "part")
    return placed.select("file", F.row_number().over(order).alias("line_no"), "text")


def _placed(lines: DataFrame) -> DataFrame:
    return lines.select("file", F.col("line_no").cast("double").alias("place"), F.lit(0).alias("part"), "text")


def insert(lines: DataFrame, new: DataFrame) -> DataFrame:
    """new: file, place (a line number; .5 more puts it behind that line), part (order among equals), text."""
    return renumber(_placed(lines).unionByName(new.select("file", F.col("place").cast("double"), F.col("part").cast("int"), "text")))


def insert_at_first(lines: DataFrame, text: str, keyword: str) -> DataFrame:
    """Before the first line that has the keyword; files without one stay as they are."""
    at = lines.filter(F.col("text").contains(keyword)).groupBy("file").agg((F.min("line_no") - 0.5).alias("place"))
    return insert(lines, at.select("file", "place", F.lit(0).alias("part"), F.lit(text).alias("text")))


def insert_after_last(lines: DataFrame, text: str, *keywords: str) -> DataFrame:
    """Behind the last line that starts with one of the keywords; on top of files without one."""
    starts = F.lit(False)
    for k in keywords:
        starts = starts | F.ltrim("text").startswith(k)
    at = lines.groupBy("file").agg((F.coalesce(F.max(F.when(starts, F.col("line_no"))), F.lit(0)) + 0.5).alias("place"))
    return insert(lines, at.select("file", "place", F.lit(0).alias("part"), F.lit(text).alias("text")))


def append(lines: DataFrame, text: str) -> DataFrame:
    at = lines.groupBy("file").agg((F.max("line_no") + 0.5).alias("place"))
    return insert(lines, at.select("file", "place", F.lit(0).alias("part"), F.lit(text).alias("text")))


def delete_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    return renumber(_placed(lines.join(covered(lines, ranges).select("file", "line_no"), ["file", "line_no"], "left_anti")))


def blank_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    gone = covered(lines, ranges).select("file", "line_no").distinct().withColumn("_gone", F.lit(True))
    return lines.join(gone, ["file", "line_no"], "left").select("file", "line_no", F.when(F.col("_gone"), "").otherwise(F.col("text")).alias("text"))


def replace_line(lines: DataFrame, file: str, line_no: int, text: str) -> DataFrame:
    """Sets one line; a file that is too short gets blank lines up to it."""
    have = lines.filter(F.col("file") == file).agg(F.coalesce(F.max("line_no"), F.lit(0)).alias("n"))
    more = have.filter(F.col("n") < line_no).select(F.lit(file).alias("file"), F.explode(F.sequence(F.col("n") + 1, F.lit(line_no))).alias("line_no"))
    more = more.select("file", F.col("line_no").cast("int").alias("line_no"), F.when(F.col("line_no") == line_no, text).otherwise("").alias("text"))
    set_ = lines.withColumn("text", F.when((F.col("file") == file) & (F.col("line_no") == line_no), F.lit(text)).otherwise(F.col("text")))
    return set_.select("file", "line_no", "text").unionByName(more)


def rename(lines: DataFrame, old: str, new: str) -> DataFrame:
    return lines.withColumn("text", rename_word(F.col("text"), old, new))


#: A moved body comes behind the last line of its target that has one of these.
HEAD_MARKS = ("#include", "#define")


def move_bodies(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Function bodies (file, start, end) moved to `<file>_code.c`; the old places are blank.

    Where that file exists, bodies come behind its last include or define, on top if it has none; where not, they are the
    file. Bodies of one target are in the order of their files and starts. A span's lines are moved whole, also where
    another span has them; lines of a target that are moved on themselves are blank there.
    """
    target = F.concat(F.regexp_replace("file", r"\.c$", ""), F.lit("_code.c"))
    body = line_slice(lines, spans.select("file", "start", "end").distinct()).select(target.alias("target"), "file", "start", "end", "line_no", "text")
    part = F.row_number().over(Window.partitionBy("target").orderBy("file", "start", "end", "line_no"))
    moved = body.select(F.col("target").alias("file"), part.alias("part"), "text")
    left, targets = blank_ranges(lines, spans), moved.select("file").distinct()
    held = left.join(targets, "file", "left_semi")
    marked = functools.reduce(Column.__or__, (F.contains("text", F.lit(m)) for m in HEAD_MARKS))
    head = held.filter(marked).groupBy("file").agg(F.max("line_no").alias("head"))
    new = moved.join(head, "file", "left").select("file", (F.coalesce("head", F.lit(0)) + 0.5).alias("place"), "part", "text")
    return left.join(targets, "file", "left_anti").unionByName(insert(held, new))


def interface_rows(functions: DataFrame) -> DataFrame:
    """Macro row, stub and new name of interface functions (name, return_type, parameters)."""
    nothing = F.trim("return_type") == "void"
    stub = F.concat(F.col("return_type"), F.lit(" "), F.col("name"), F.lit("("), F.col("parameters"), F.lit(") { "), F.when(nothing, "return;").otherwise("return -1;"), F.lit(" }"))
    return functions.select("name", F.concat(F.lit("mod_"), "name").alias("new_name"), F.format_string("INTERFACE(%s)", F.col("name")).alias("macro"), stub.alias("stub"))


def guarded_includes(includes: DataFrame) -> DataFrame:
    """Header lines for include lists (file, style, target, ordinal), each list inside its file's guard."""
    guard = include_guard(F.col("file"))
    one = F.when(F.col("style") == "angle", F.concat(F.lit("#include <"), "target", F.lit(">"))).otherwise(F.concat(F.lit('#include "'), "target", F.lit('"')))
    body = includes.select("file", F.when(F.col("style") == "angle", 1).otherwise(2).alias("place"), F.col("ordinal").alias("part"), one.alias("text"))
    files = includes.select("file").distinct()
    head = files.select("file", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit(0).alias("part"), F.concat(F.lit("#ifndef "), guard).alias("text")), F.struct(F.lit(0).alias("place"), F.lit(1).alias("part"), F.concat(F.lit("#define "), guard).alias("text")), F.struct(F.lit(9).alias("place"), F.lit(0).alias("part"), F.lit("#endif").alias("text")))).alias("h")).select("file", "h.*")
    return renumber(body.unionByName(head))


def symbol_rows(used: DataFrame, macro: str) -> DataFrame:
    """One macro row for each unexported name."""
    return used.select("name", F.format_string(macro + "(%s)", F.col("name")).alias("text"))


def export_macros(lines: DataFrame, wanted: DataFrame, header: str = "linux/export.h") -> DataFrame:
    """lines with the header's include and `EXPORT_SYMBOL(name);` for each wanted row (file, name) at the files' ends.

    What a file has already is not added again; the include comes before the macros, macros by name.
    """
    include = f"#include <{header}>"
    row = F.concat(F.lit("EXPORT_SYMBOL("), "name", F.lit(");"))
    new = wanted.select("file", row.alias("text"), F.lit(1).alias("rank")).unionByName(wanted.select("file", F.lit(include).alias("text"), F.lit(0).alias("rank"))).distinct()
    held = lines.select("file", F.explode(F.array(F.regexp_extract("text", r"(EXPORT_SYMBOL\(\w+\);)", 1), F.when(F.contains("text", F.lit(include)), F.lit(include)))).alias("text")).filter("text <> ''").distinct()
    lacking = new.join(held, ["file", "text"], "left_anti")
    ends = lines.groupBy("file").agg((F.max("line_no") + 0.5).alias("place"))
    part = F.row_number().over(Window.partitionBy("file").orderBy("rank", "text"))
    return insert(lines, lacking.join(ends, "file").select("file", "place", part.alias("part"), "text"))


def module_include(lines: DataFrame, touched: DataFrame, header: str = "linux/module.h") -> DataFrame:
    """`#include` of the header before the first include of touched files that lack it."""
    wanted = f"#include <{header}>"
    lacking = touched.select("file").distinct().join(lines.filter(F.trim("text") == wanted).select("file"), "file", "left_anti")
    at = lines.join(lacking, "file", "left_semi").filter(F.ltrim("text").startswith("#include")).groupBy("file").agg((F.min("line_no") - 0.5).alias("place"))
    return insert(lines, at.select("file", "place", F.lit(0).alias("part"), F.lit(wanted).alias("text")))


def inline_bodies(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts of inline functions (file, name, start, end) outside headers."""
    rows = line_slice(lines, spans.filter(~F.col("file").endswith(".h")).select("file", "name", "start", "end"))
    body: Column = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return rows.groupBy("file", "name").agg(body.alias("rows")).select("file", "name", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("body"))
