"""Refreshed advice against advice from scratch, and what a refresh leaves alone."""

import os
import random
import time

from kitefin.plans.incremental import refresh


def write(root, graphs):
    for file, lines in graphs.items():
        path = root / f"{file}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f"{a}@isDefinition -> {' '.join(b + '@isDefinition' for b in found)}\n" for a, found in lines.items()))


def advice(spark, path):
    return sorted(map(tuple, spark.read.parquet(f"{path}/advice").select("subsystem", "name", "recommendation", "component").collect()))


def stamps(path):
    return {d: sorted(os.listdir(path / "advice" / d)) for d in os.listdir(path / "advice") if d.startswith("subsystem=")}


def test_refresh(spark, tmp_path):
    r = random.Random(4)
    names = {f: [f"{f.replace('/', '_')}_{k}" for k in range(4)] for f in ("a/b/x", "a/b/y", "a/c/z", "d/e/u", "d/v", "g/w")}
    near = lambda f: [n for g, ns in names.items() if g.split("/")[0] == f.split("/")[0] for n in ns]
    graphs = {f: {n: r.sample(near(f), 2) for n in ns} for f, ns in names.items()}
    graphs["g/w"] = {names["g/w"][0]: [names["g/w"][1], "printk"]}
    src, state = tmp_path / "src", tmp_path / "state"
    types = spark.createDataFrame([(names["d/v"][0], "INIT")], "name string, type string")
    write(src, graphs)

    def step(dirty):
        got = {x.subsystem for x in refresh(spark, str(src), str(state), types).collect()}
        fresh = tmp_path / f"fresh-{time.time_ns()}"
        refresh(spark, str(src), str(fresh), types)
        assert advice(spark, state) == advice(spark, fresh)
        assert got == dirty

    step({"/a", "/a/b", "/a/c", "/d", "/d/e", "/g"})
    before = stamps(state)
    step(set())
    assert stamps(state) == before
    # One file calls a function of its own directory alone; the rest stays as it was written.
    time.sleep(1.1)
    write(src, {"g/w": {names["g/w"][0]: [names["g/w"][1], names["g/w"][2]], names["g/w"][2]: [names["g/w"][2]]}})
    step({"/g"})
    after = stamps(state)
    assert {d for d in before if before[d] != after.get(d)} == {"subsystem=%2Fg"}
    # A call into another directory makes that one dirty, a deleted file what it called.
    write(src, {"g/w": {names["g/w"][0]: [names["d/e/u"][1]]}})
    os.utime(src / "g/w.txt", (time.time() + 5, time.time() + 5))
    step({"/g", "/d", "/d/e"})
    (src / "g/w.txt").unlink()
    step({"/g", "/d", "/d/e"})
    assert "subsystem=%2Fg" not in stamps(state)
