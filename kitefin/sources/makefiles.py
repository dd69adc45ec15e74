"""Kbuild makefiles: statements, substitution of composite objects, descent into directories, modules of a config."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import by_key, checkpoint
from .text_lines import continuation_groups

CORE = "core"
#: Assignments of Kbuild makefiles: what is assigned to, one of the four operators, the values.
ASSIGNMENT = r"^([^\s:+?=]+)\s*[:+?]?=\s*(\S.*)$"


def statements(lines: DataFrame) -> DataFrame:
    """dir, line_no, form, subject, config, target (one row for each) of makefile lines (file = directory).

    `obj-y` is core; `obj-$(CONFIG)` belongs to a config; `name-y` and `name-objs` list the members of a composite object,
    `name-$(CONFIG)` those under a config; any other name is a variable. Compiler flags of directories are left out.
    """
    text = F.trim("text")
    folded = continuation_groups(lines).select(F.col("file").alias("dir"), "line_no", *(F.regexp_extract(text, ASSIGNMENT, k).alias(c) for k, c in ((1, "left"), (2, "right"))))
    cut = folded.select("dir", "line_no", "left", "right", F.regexp_extract("left", "^(.*)-([^-]*)$", 1).alias("stem"), F.regexp_extract("left", "^(.*)-([^-]*)$", 2).alias("last"))
    cut = cut.withColumn("config", F.regexp_extract("last", r"^\$\(([A-Za-z0-9_]+)\)$", 1))
    conditional, listed = (F.col("stem") != "") & (F.col("config") != ""), (F.col("stem") != "") & F.col("last").isin("y", "objs")
    form = F.when(conditional, F.when(F.col("stem") == "obj", "config").otherwise("object_config")).when(F.col("left") == "obj-y", CORE).when(listed, "object").when(F.col("left").rlike("^[-A-Za-z0-9_]+$"), "variable")
    formed = cut.select("dir", "line_no", "left", "right", "stem", form.alias("form"), F.when(conditional, F.col("config")).otherwise("").alias("config"))
    subject = F.when(F.col("form").isin("object", "object_config"), F.col("stem")).when(F.col("form") == "variable", F.col("left")).otherwise("")
    parsed = formed.select("dir", "line_no", "form", subject.alias("subject"), "config", F.explode(F.split(F.trim("right"), r"\s+")).alias("target"))
    # Written down, as what follows looks at the statements of each form apart.
    return checkpoint(parsed.filter("form is not null and target <> '' and subject <> 'ccflags'"))


def substitute(found: DataFrame) -> DataFrame:
    """Targets of configs, with composite objects and variables replaced by their members, one level: dir, config, target."""
    rules = found.filter("form in ('core', 'config')").select("dir", F.when(F.col("form") == "core", CORE).otherwise(F.col("config")).alias("config"), "target")
    members = found.filter("form in ('object', 'variable')").select(F.col("dir").alias("m_dir"), F.when(F.col("form") == "object", F.concat("subject", F.lit(".o"))).otherwise(F.concat(F.lit("$("), "subject", F.lit(")"))).alias("whole"), F.col("target").alias("member"))
    lists = found.filter("form = 'object'").select(F.col("dir").alias("m_dir"), F.concat(F.lit("$("), "subject", F.lit("-y)")).alias("whole"), F.col("target").alias("member"))
    joined = rules.join(by_key(members.unionAll(lists)), (F.col("dir") == F.col("m_dir")) & (F.col("target") == F.col("whole")), "left")
    direct = joined.select("dir", "config", F.coalesce("member", "target").alias("target"))
    # What a composite object only has under a config belongs to that config.
    return direct.unionAll(found.filter("form = 'object_config'").select("dir", "config", "target"))


def descend(rules: DataFrame, tops: DataFrame) -> DataFrame:
    """dir, config, file of all directories that can be reached from tops (dir): a target that ends in a slash leads on.

    A directory's core targets belong to the config under which it was entered.
    """
    rules = checkpoint(rules.select(F.col("dir").alias("r_dir"), F.col("config").alias("own"), "target").distinct())
    frontier = tops.select("dir", F.lit(CORE).alias("entered")).distinct()
    levels, seen = [], frontier
    while True:
        here = checkpoint(frontier.join(by_key(rules), F.col("dir") == F.col("r_dir")).select("dir", F.when(F.col("own") == CORE, F.col("entered")).otherwise(F.col("own")).alias("config"), "target"))
        levels.append(here.filter(~F.col("target").endswith("/")))
        frontier = here.filter(F.col("target").endswith("/")).select(F.concat(F.regexp_replace("dir", "/+$", ""), F.lit("/"), F.regexp_replace("target", "/+$", "")).alias("dir"), F.col("config").alias("entered")).distinct()
        frontier = checkpoint(frontier.join(by_key(seen), ["dir", "entered"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionAll(frontier))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    path = F.concat(F.regexp_replace("dir", "/+$", ""), F.lit("/"), F.regexp_replace("target", r"\.o$", ".c"))
    return out.select("config", path.alias("file")).filter(~F.col("file").contains("$")).distinct()


def module_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files of the configs that are modules, without core files."""
    core = files.filter(F.col("config") == CORE).select("file")
    return files.join(modules, "config", "left_semi").select("file").distinct().join(by_key(core), "file", "left_anti")
