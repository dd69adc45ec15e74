"""Predicates and projections over names, paths and types, as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_TYPE, GLOBAL_PREFIX, INIT_SUFFIX, RECOMMENDATION_COLOURS, TYPE_COLOURS


def clean_name(c: Column) -> Column:
    """Names are compared without the quotes that graph files put around special characters."""
    return F.regexp_replace(c, '^"|"$', "")


def strip_tag(c: Column) -> Column:
    return F.substring_index(c, "@", 1)


def is_intrinsic(c: Column) -> Column:
    return c.contains("llvm.")


def is_global(c: Column) -> Column:
    return clean_name(c).startswith(GLOBAL_PREFIX)


def kind(c: Column) -> Column:
    return F.when(is_global(c), "GV").otherwise("FUNC")


def is_graph_file(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return base.endswith(".dot") & ~base.endswith("mod.dot") & ~base.startswith("all.dot")


def is_virtual_init(c: Column) -> Column:
    return c.endswith(INIT_SUFFIX)


#: Prefixes of system calls.
SYSCALL_PREFIXES = ("ia32_", "x64_", "se_", "do_sys", "do_compat_sys")


def is_syscall(c: Column) -> Column:
    return functools.reduce(lambda x, y: x | y, (c.startswith("__" + p) for p in SYSCALL_PREFIXES))


def is_trace(c: Column) -> Column:
    return c.contains("trace") | c.contains("perf") | c.contains("__traceiter") | c.contains("__SCT__tp")


def colour(value: Column, colours: dict[str, str]) -> Column:
    """Unset stays unset; what has no colour is white."""
    table = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv])
    return F.when(value.isNotNull(), F.coalesce(F.element_at(table, value), F.lit("white")))


def type_colour(c: Column) -> Column:
    return colour(c, TYPE_COLOURS)


def recommendation_colour(c: Column) -> Column:
    return colour(c, RECOMMENDATION_COLOURS)


def default_type(c: Column) -> Column:
    return F.coalesce(c, F.lit(DEFAULT_TYPE))


def has_inline(body: Column) -> Column:
    return body.rlike(r"\binline\b")


def inline_or_unknown(found: Column) -> Column:
    return F.coalesce(found, F.lit(True))


def resolved(files: Column) -> Column:
    return F.filter(files, lambda f: ~f.contains("$"))


def global_handling(name: Column, c_type: Column) -> Column:
    """How a used global can be reached: as an array, as a variable, or not at all."""
    usable = ~name.contains(".") & ~c_type.contains(".") & (c_type != "")
    return F.when(~usable, "SKIP").when(c_type.contains("["), "ARRAY").otherwise("VARIABLE")


def is_header(path: Column) -> Column:
    return path.endswith(".h")


def all_zero(*counts: Column) -> Column:
    out = F.lit(True)
    for c in counts:
        out = out & (c == 0)
    return out


def path_prefixes(path: Column) -> Column:
    """All directories above a file: /a/b/c.x gives /a and /a/b."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    depth = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.transform(depth, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))


def depth(directory: Column) -> Column:
    return F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit("")))


def virtual_init_name(module: Column) -> Column:
    return F.concat(F.regexp_replace(module, "[/.-]", "_"), F.lit(INIT_SUFFIX))
