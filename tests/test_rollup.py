"""Advice bottom-up against advice for each directory of its own; unified values against their fix-point."""

import random

import pytest

from kitefin.operators import facts
from kitefin.plans import datasets, rollup
from kitefin.plans.advise import KEPT, advise, by_subsystem


@pytest.mark.parametrize("seed, few", [(1, 500_000), (2, 500_000), (3, 0)])
def test_rollup_is_the_advice(spark, seed, few):
    r = random.Random(seed)
    folders = ["", "/a", "/a/b", "/a/b/c", "/a/b/c/d", "/a/bc", "/e", "/e/f"]
    nodes = [(f"f{k}", f"{r.choice(folders)}/x{k % 3}.c", r.choice([*KEPT, *KEPT, "INIT"])) for k in range(50)]
    names = [n for n, _, _ in nodes] + ["outside"]
    edges = {(r.choice(names), r.choice(names)) for _ in range(45)} | {("f1", "f2"), ("f2", "f3"), ("f3", "f3")}
    n = spark.createDataFrame(nodes, "name string, file string, type string")
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    owner = n.selectExpr("name as src", "file")
    want = sorted(map(tuple, advise(*by_subsystem(n, e.join(owner, "src").select("file", "src", "dst")), e).select("subsystem", "name", "recommendation", "component").collect()))
    got = sorted(map(tuple, rollup.advise_rollup(n, e, few).select("subsystem", "name", "recommendation", "component").collect()))
    assert got == want and {x[2] for x in got} == {"INTERFACE", "NORMAL", "DELETE"}


def test_rollup_of_nothing(spark):
    n = spark.createDataFrame([("f", "/a/b/x.c", "PLAIN"), ("top", "x.c", "PLAIN")], "name string, file string, type string")
    e = spark.createDataFrame([], "src string, dst string")
    assert sorted(map(tuple, rollup.advise_rollup(n, e).collect())) == [("/a", "f", "DELETE", "f"), ("/a/b", "f", "DELETE", "f")]
    assert rollup.advise_rollup(n.limit(0), e).count() == 0


def test_classes_hold_all_that_values_point_at(spark, sf_dir):
    operands, instructions, constants, aliases = datasets.program(spark, sf_dir)
    copies, taken = facts.copies(operands, instructions), facts.taken_functions(operands, instructions, constants, aliases)
    classes, pointed = facts.unify(copies, taken)
    every = classes.join(pointed, "class").select("value", "func")
    fixed = facts.points_to(copies, taken.select("value", "func"))
    assert fixed.select("value", "func").subtract(every).isEmpty() and classes.groupBy("value").count().filter("count > 1").isEmpty()
    # Classes and what they point at are no more rows than values and functions taken; pairs may be many more.
    assert pointed.count() <= taken.select("value", "func").distinct().count() and fixed.count() <= every.count()
