"""Text files as (file, line_no, text) tables, and scans over them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..shared import checkpoint


def by_line() -> WindowSpec:
    return Window.partitionBy("file").orderBy("line_no")


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.txt") -> DataFrame:
    """Lines of all files below path, or of files named one by one, numbered; a file is read by as many tasks as it has splits.

    Lines are counted for each split, and the counts of a file's earlier splits are its offset. Rows are written down once
    between counting and numbering, so that both see the same splits. Lines end with a line feed, with or without a
    carriage return before it; what stands behind the last one is a line if it isn't empty.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    # A task's rows are numbered in order, and a split is in one task.
    rows = checkpoint(text.select(*place, F.regexp_replace("value", r"\r$", "").alias("text")))
    counts = rows.groupBy(F.col("file").alias("c_file"), F.col("split").alias("c_split")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("c_file").orderBy("c_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("c_file", "c_split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    held = rows.join(offsets, (F.col("file") == F.col("c_file")) & (F.col("split") == F.col("c_split")))
    return held.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("line_no"), "text")


def take_while(lines: DataFrame, holds: Column) -> DataFrame:
    """Each file's lines up to the first one for which the predicate doesn't hold."""
    seen = F.sum(F.when(holds, 0).otherwise(1)).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_broken", seen).filter("_broken = 0").drop("_broken")


def covered(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row for each line inside [start, end] of ranges (file, start, end, ...): line_no and the range's columns.

    Ranges are cut to their file's lines before they are written out, so that joins with lines are on (file, line_no).
    """
    last = lines.groupBy(F.col("file").alias("_file")).agg(F.max("line_no").alias("_last"))
    first, end = F.greatest("start", F.lit(1)).cast("int"), F.least("end", "_last").cast("int")
    held = ranges.join(last, F.col("file") == F.col("_file")).withColumns({"_first": first, "_end": end}).filter("_first <= _end")
    return held.select(*ranges.columns, F.explode(F.sequence("_first", "_end")).alias("line_no"))


def line_slice(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines inside [start, end] of ranges (file, start, end, ...), with the range's columns."""
    return lines.join(covered(lines, ranges), ["file", "line_no"])


def continuation_groups(lines: DataFrame, mark: str = "\\") -> DataFrame:
    """Lines folded over a mark at the line's end: file, first line, text without the marks, number of lines."""
    goes_on = F.rtrim("text").endswith(mark)
    begins = F.coalesce((~F.lag(goes_on).over(by_line())).cast("int"), F.lit(1))
    grouped = lines.withColumn("_group", F.sum(begins).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(goes_on, F.expr(f"left(rtrim(text), length(rtrim(text)) - {len(mark)})")).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", part.alias("part"))))
    folded = grouped.groupBy("file", "_group").agg(F.min("line_no").alias("line_no"), parts.alias("parts"), F.count("*").alias("n_lines"))
    return folded.select("file", "line_no", F.array_join(F.transform("parts", lambda p: F.trim(p["part"])), " ").alias("text"), "n_lines")


def symbol_list(lines: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Distinct trimmed names; blank lines are names only for export lists."""
    names = lines.select(F.trim("text").alias("name"))
    return (names if keep_blank else names.filter("name <> ''")).distinct()


def includes(lines: DataFrame) -> DataFrame:
    """file, style (angle or quote), target: distinct, in the order of first lines (`ordinal`)."""
    text = F.trim("text")
    angle, quote = F.regexp_extract(text, r"^#include\s*<([^>]+)>", 1), F.regexp_extract(text, r'^#include\s*"([^"]+)"', 1)
    found = lines.select("file", "line_no", F.when(angle != "", "angle").when(quote != "", "quote").alias("style"), F.when(angle != "", angle).otherwise(quote).alias("target")).filter("style is not null")
    firsts = found.groupBy("file", "style", "target").agg(F.min("line_no").alias("line_no"))
    return firsts.select("file", "style", "target", F.row_number().over(Window.partitionBy("file", "style").orderBy("line_no")).alias("ordinal"))


def macros(lines: DataFrame) -> DataFrame:
    """`#define` statements, continuations folded into one line."""
    return continuation_groups(lines).filter(F.ltrim("text").startswith("#define")).select("file", "line_no", F.trim("text").alias("text"))


def _spans(batches):
    """Of lines in order and the starts among them: where the braces that open at or after a start balance.

    Starts wait for an opening brace; then they are open until the level is back at what it was before that brace. Later
    ones open at higher levels, so that a stack has them all and each line and each start is looked at once.
    """
    file, level = None, 0
    waiting: list[int] = []
    open_: list[tuple[int, int]] = []
    for batch in batches:
        out: list[tuple] = []
        for f, number, start, change, opens in zip(*(batch.column(c).to_pylist() for c in ("file", "line_no", "start", "change", "opens"))):
            if f != file:
                file, level, waiting, open_ = f, 0, [], []
            if start:
                waiting.append(number)
            if opens:
                open_ += [(level, x) for x in waiting]
                waiting = []
            level += change
            while open_ and open_[-1][0] >= level:
                out.append((file, open_.pop()[1], number))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.int32(), pa.int32()))], names=["file", "start", "end"])


def brace_spans(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """End of the braces that open at or after each start (file, start): the first line where they balance.

    A file's lines pass through one task in order, once, however many starts it has; the task holds only open starts.
    """
    at = starts.select("file", F.col("start").cast("int").alias("line_no"), F.lit(True).alias("is_start")).distinct()
    change = F.regexp_count("text", F.lit(r"\{")) - F.regexp_count("text", F.lit(r"\}"))
    marks = lines.select("file", F.col("line_no").cast("int").alias("line_no"), F.coalesce(change, F.lit(0)).alias("change"), F.coalesce(F.contains("text", F.lit("{")), F.lit(False)).alias("opens"))
    rows = marks.join(at, ["file", "line_no"], "left").select("file", "line_no", F.coalesce("is_start", F.lit(False)).alias("start"), "change", "opens")
    ends = rows.repartition("file").sortWithinPartitions("file", "line_no").mapInArrow(_spans, "file string, start int, end int")
    return starts.select("file", "start").join(ends, ["file", "start"], "left").select("file", "start", F.coalesce("end", "start").alias("end"))


def return_type_line(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """First line of a definition: the one above if nothing stands before the name on its own line."""
    named = starts.select(F.col("file").alias("_file"), "start")
    head = F.substring_index("text", "(", 1)
    before = F.regexp_extract(head, r"^(.*?)(\S+)\s*$", 1)
    at = lines.join(named, (F.col("file") == F.col("_file")) & (F.col("line_no") == F.col("start")))
    return at.select("file", "start", (F.col("start") - F.when(F.trim(before) == "", 1).otherwise(0)).alias("first"))


def struct_definitions(lines: DataFrame) -> DataFrame:
    """file, name, start, end of `struct name {`, by brace balance."""
    name = F.regexp_extract("text", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{", 1)
    starts = lines.select("file", F.col("line_no").alias("start"), name.alias("name")).filter("name <> ''")
    return starts.join(brace_spans(lines, starts), ["file", "start"]).select("file", "name", "start", "end")


def config_modules(lines: DataFrame) -> DataFrame:
    """Names of options that are set to m."""
    return lines.filter(F.col("text").contains("=m")).select(F.substring_index("text", "=", 1).alias("config")).distinct()


def build_outcomes(logs: DataFrame, rewritten: str, built: str) -> DataFrame:
    """total, first step done, and second step done given the first, of logs (path, content)."""
    one, two = F.col("content").contains(rewritten), F.col("content").contains(built)
    return logs.agg(F.count("*").alias("total"), F.count_if(one).alias("rewritten"), F.count_if(one & two).alias("built"))


def latest_modification(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path)
    return files.agg(F.max("modificationTime").alias("latest"))
