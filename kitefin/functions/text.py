"""Scalar text functions of the source tools, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rename_word(text: Column, old: str, new: str) -> Column:
    """Whole words only, as in C identifiers."""
    return F.regexp_replace(text, rf"\b{re.escape(old)}\b", new.replace("$", r"\$"))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def include_guard(path: Column) -> Column:
    return F.upper(F.regexp_replace(path, "[^a-zA-Z0-9]", "_"))


def strip_comments(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def count_of(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def fold_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\s*", " ")


def swap_extension(path: Column, new: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", new)


def join_path(directory: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(directory, "/+$", ""), F.lit("/"), F.regexp_replace(name, "^/+", ""))


def first_parentheses(text: Column) -> Column:
    """Struct of the places, from 1, of the first `(` and of the `)` that closes it; nulls where there is none.

    A fold over the characters with the depth so far: no row is exploded.
    """
    start = F.locate("(", text)
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    rest = F.split(F.substr(text, start), "")

    def step(s: Column, c: Column) -> Column:
        change = F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        level, at = s["depth"] + change, s["at"] + 1
        return F.struct(level.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (c == ")") & (level == 0), at).otherwise(s["end"]).alias("end"))

    found = F.aggregate(rest, state, step)
    closed = (start > 0) & (found["end"] > 0)
    return F.struct(F.when(closed, start).alias("open"), F.when(closed, start + found["end"] - 1).alias("close"))


def signature(code: Column) -> Column:
    """Struct of a function's return type (without static and inline), name, parameters and body."""
    clean = strip_comments(code)
    pair = first_parentheses(clean)
    before = F.substr(clean, F.lit(1), pair["open"] - 1)
    name = F.regexp_extract(before, r"(\w+)\W*$", 1)
    kept = F.regexp_replace(F.regexp_replace(F.regexp_extract(before, r"(?s)^(.*?)\w+\W*$", 1), r"\b(static|inline)\b", ""), r"^\s+|\s+$", "")
    opening = F.locate("{", clean)
    body = F.regexp_extract(F.substr(clean, opening), r"(?s)^(\{.*\})", 1)
    return F.struct(kept.alias("return_type"), name.alias("name"), F.substr(clean, pair["open"] + 1, pair["close"] - pair["open"] - 1).alias("parameters"), body.alias("body"))


#: C names of compiler types.
C_TYPES = {"void": "void", "i1": "bool", "i8": "char", "i16": "short", "i32": "int", "i64": "long long", "float": "float", "double": "double"}


def c_type(ir: Column) -> Column:
    """C text of a compiler type like `[4 x i32]`, `i8**`, `%struct.page*`; empty where there is none.

    Layers of pointers and arrays are peeled off from the outside: an array's element type comes first, then ` []`.
    """
    text = F.trim(ir)
    stars = F.regexp_extract(text, r"(\**)$", 1)
    inner = F.regexp_replace(text, r"\**$", "")
    arrays = F.regexp_count(inner, F.lit(r"\[\d+ x "))
    core = F.regexp_replace(F.regexp_replace(inner, r"\[\d+ x ", ""), r"\]+$", "")
    inner_stars = F.regexp_extract(core, r"(\**)$", 1)
    core = F.regexp_replace(core, r"\**$", "")
    table = F.create_map(*[F.lit(x) for kv in C_TYPES.items() for x in kv])
    named = F.when(core.startswith("%struct."), F.concat(F.lit("struct "), F.substring(core, 9, 1_000_000))).otherwise(F.coalesce(F.element_at(table, core), F.lit("")))
    return F.concat(named, F.repeat(F.lit(" *"), F.length(inner_stars)), F.repeat(F.lit(" []"), arrays), F.repeat(F.lit(" *"), F.length(stars)))
