"""Elimination hierarchies: distances and strongly connected components of deep graphs in few rounds of joins.

A round takes out nodes, no two of them neighbours, that have no more pairs of edges through them than edges (in * out
<= in + out), and puts an edge as long as the two in the place of each pair. So edges never grow in number, and what
remains has its distances and its cycles unchanged. Chains, trees, ladders and whatever hangs on a graph by few edges
shrink by a constant share a round: rounds grow with the logarithm of a path's length, not with the length. What is left
is a core where most nodes have several edges each way; it is small enough for one task or is searched in rounds. Then
nodes come back in the reverse order: each round's had, when they went, neighbours alone that are known by then.
"""

from __future__ import annotations

import dataclasses
import functools
import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import by_key

#: A round that takes out fewer nodes than this share of the edges is the last.
LEAST_SHARE = 0.02


@dataclasses.dataclass
class Level:
    """Nodes that a round took out: their edges in (key, name, src, w) and out (key, name, dst, w), and their start."""

    ins: DataFrame
    outs: DataFrame
    start: DataFrame | None


@dataclasses.dataclass(frozen=True)
class Values:
    """What is known of nodes: the least or greatest of each column over all ways to a node; `add` grows by an edge's w."""

    best: dict[str, str]
    add: str | None = None

    def least(self, df: DataFrame) -> DataFrame:
        return df.groupBy("key", "name").agg(*(getattr(F, how)(c).alias(c) for c, how in self.best.items()))

    def along(self, df: DataFrame, name: str) -> DataFrame:
        return df.select("key", F.col(name).alias("name"), *((F.col(c) + F.col("w")).alias(c) if c == self.add else F.col(c) for c in self.best))

    def better(self, df: DataFrame, known: DataFrame) -> DataFrame:
        """Rows that improve on what is known."""
        old = known.select("key", "name", *(F.col(c).alias(f"old_{c}") for c in self.best))
        improves = functools.reduce(lambda a, b: a | b, (F.col(c) < F.col(f"old_{c}") if how == "min" else F.col(c) > F.col(f"old_{c}") for c, how in self.best.items()))
        return df.join(by_key(old), ["key", "name"], "left").filter(F.col(f"old_{next(iter(self.best))}").isNull() | improves).select("key", "name", *self.best)


class Sets(Values):
    """All that is known of nodes, in a row each."""

    def least(self, df: DataFrame) -> DataFrame:
        return df.select("key", "name", *self.best).distinct()


LENGTHS = Values({"d": "min"}, "d")
HELD = Sets({"value": "min"})


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _with(known: DataFrame, new: DataFrame, checkpoint) -> DataFrame:
    """Both as one table. Levels grow by a constant factor, so that all writing together is linear."""
    return checkpoint(known.unionByName(new).repartition("key", "name"))


def eliminate(edges: DataFrame, small, checkpoint, start: DataFrame | None = None, values: Values = LENGTHS) -> tuple[list[Level], DataFrame, DataFrame | None]:
    """Levels, the core's edges and its start. edges: key, src, dst, w; start: key, name and the values known from outside.

    small tells whether edges are few enough to stop.
    """
    levels: list[Level] = []
    e = edges
    while not small(e):
        side = lambda c, into: F.struct(F.col(c).alias("name"), F.lit(into).cast("long").alias("into"))
        ends = e.select("key", F.explode(F.array(side("src", 0), side("dst", 1))).alias("end")).select("key", "end.*")
        degrees = ends.groupBy("key", "name").agg(F.sum("into").alias("into"), F.sum(1 - F.col("into")).alias("out"))
        rank = F.xxhash64("key", "name", F.lit(len(levels)))
        able = degrees.filter(F.col("into") * F.col("out") <= F.col("into") + F.col("out")).select("key", "name", rank.alias("rank"))
        before, behind = (able.select("key", F.col("name").alias(c), F.col("rank").alias(f"{c}_rank")) for c in ("src", "dst"))
        near = e.join(by_key(before), ["key", "src"]).join(by_key(behind), ["key", "dst"])
        later = F.struct("src_rank", "src") > F.struct("dst_rank", "dst")
        lost = near.select("key", F.when(later, F.col("src")).otherwise(F.col("dst")).alias("name")).distinct()
        chosen = able.join(by_key(lost), ["key", "name"], "left_anti").select("key", "name", F.lit(True).alias("gone"))
        marks = [chosen.select("key", F.col("name").alias(c), F.col("gone").alias(f"{c}_gone")) for c in ("src", "dst")]
        marked = checkpoint(e.join(by_key(marks[0]), ["key", "src"], "left").join(by_key(marks[1]), ["key", "dst"], "left"))
        gone = marked.filter("src_gone or dst_gone").select("key", F.when(F.col("src_gone"), F.col("src")).otherwise(F.col("dst")).alias("name")).distinct()
        if gone.count() <= LEAST_SHARE * marked.count():
            break
        ins = marked.filter("dst_gone").select("key", F.col("dst").alias("name"), "src", "w")
        outs = marked.filter("src_gone").select("key", F.col("src").alias("name"), "dst", "w")
        both = ins.join(by_key(outs.withColumnRenamed("w", "v")), ["key", "name"]).filter("src <> dst")
        rest = marked.filter("src_gone is null and dst_gone is null").select("key", "src", "dst", "w")
        e = checkpoint(rest.unionByName(both.select("key", "src", "dst", (F.col("w") + F.col("v")).alias("w"))).groupBy("key", "src", "dst").agg(F.min("w").alias("w")))
        own = None
        if start is not None:
            own = start.join(by_key(gone), ["key", "name"], "left_semi")
            pushed = values.along(own.join(by_key(outs), ["key", "name"]), "dst")
            start = checkpoint(values.least(start.join(by_key(gone), ["key", "name"], "left_anti").unionByName(pushed)))
        levels.append(Level(ins, outs, own))
    return levels, e, start


def _cogrouped(edges: DataFrame, others: DataFrame, kernel, schema: str) -> DataFrame:
    def run(e: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        after = defaultdict(list)
        for a, b, w in zip(e["src"], e["dst"], e["w"]):
            after[a].append((b, w))
        out = pd.DataFrame(kernel(after, o), columns=[c.split()[0] for c in schema.split(", ")][1:])
        out.insert(0, "key", (e if len(e) else o)["key"].iloc[0] if len(e) + len(o) else None)
        return out

    # Columns of their own, also where one comes from the other.
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))
    return fresh(edges).groupBy("key").cogroup(fresh(others).groupBy("key")).applyInPandas(run, schema)


def _dijkstra(after, o):
    heap = [(d, n) for n, d in zip(o["name"], o["d"])]
    heapq.heapify(heap)
    found: dict = {}
    while heap:
        d, a = heapq.heappop(heap)
        if a not in found:
            found[a] = d
            for b, w in after.get(a, ()):
                if b not in found:
                    heapq.heappush(heap, (d + w, b))
    return list(found.items())


def _worklist(after, o):
    """Values (lo, hi) go along edges until nothing changes."""
    held = {n: (lo, hi) for n, lo, hi in zip(o["name"], o["lo"], o["hi"])}
    at = list(held)
    while at:
        a = at.pop()
        lo, hi = held[a]
        for b, _ in after.get(a, ()):
            old = held.get(b, (lo, hi))
            new = (min(lo, old[0]), max(hi, old[1]))
            if new != old or b not in held:
                held[b] = new
                at.append(b)
    return [(n, *v) for n, v in held.items()]


def _solve(edges: DataFrame, start: DataFrame, small, checkpoint, values: Values, kernel, columns: str) -> DataFrame:
    kind = dict(edges.dtypes)["key"]
    start = checkpoint(values.least(start))
    levels, core, left = eliminate(edges.filter("src <> dst"), small, checkpoint, start, values)  # no way to itself is better
    if small(core):
        alone = core.select("key", F.col("src").alias("name")).distinct()
        inner = _cogrouped(core, left.join(by_key(alone), ["key", "name"], "left_semi"), kernel, f"key {kind}, name string, {columns}")
        best = values.least(inner.unionByName(left))
    else:
        best = frontier = left
        while True:
            step = values.least(values.along(frontier.join(by_key(core.withColumnRenamed("src", "name")), ["key", "name"]), "dst"))
            frontier = checkpoint(values.better(step, best))
            if frontier.isEmpty():
                break
            best = checkpoint(values.least(best.unionByName(frontier)))
    known = checkpoint(best)
    for level in reversed(levels):
        via = values.along(level.ins.join(by_key(known.withColumnRenamed("name", "src")), ["key", "src"]), "name")
        known = _with(known, values.least(via.unionByName(level.start)), checkpoint)
    return known


def distances(edges: DataFrame, start: DataFrame, small, checkpoint) -> DataFrame:
    """key, name, d: the least of start (key, name, d) and of what edges (key, src, dst, w) lead to from there."""
    return _solve(edges, start, small, checkpoint, LENGTHS, _dijkstra, "d long")


def extremes(edges: DataFrame, start: DataFrame, small, checkpoint) -> DataFrame:
    """key, name, lo, hi: the least lo and greatest hi (strings) of start (key, name, lo, hi) over the node and all that
    edges (key, src, dst) lead to it from."""
    weighted = edges.select("key", "src", "dst", F.lit(1).cast("long").alias("w"))
    return _solve(weighted, start, small, checkpoint, Values({"lo": "min", "hi": "max"}), _worklist, "lo string, hi string")


def _tarjan(after, o):
    """Each node of a task's graph with the least name of its component."""
    number, low, place, held, stack, out = {}, {}, {}, set(), [], []

    def enter(a):
        number[a] = low[a] = len(number)
        place[a] = len(stack)
        stack.append(a)
        held.add(a)

    for root in list(after):
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        enter(root)
        while work:
            a, rest = work[-1]
            for b, _ in rest:
                if b not in number:
                    enter(b)
                    work.append((b, iter(after.get(b, ()))))
                    break
                if b in held:
                    low[a] = min(low[a], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[a])
                if low[a] == number[a]:
                    members = stack[place[a] :]
                    del stack[place[a] :]
                    held.difference_update(members)
                    least = min(members)
                    out += [(m, least) for m in members]
    return out


def _coloured(core: DataFrame, checkpoint) -> DataFrame:
    """key, name, label of the core's nodes, by colours.

    A node's colour is the least name that leads to it. A component is inside one colour, and the one of the colour's own
    node is what leads back to that node inside the colour; the rest goes on without edges between colours.
    """
    ends = lambda e: e.select("key", F.explode(F.array("src", "dst")).alias("name")).distinct()
    e, labelled = core.select("key", "src", "dst"), []
    every = checkpoint(ends(e))
    while not e.isEmpty():
        colour = frontier = checkpoint(ends(e).withColumn("colour", F.col("name")))
        while True:
            step = frontier.withColumnRenamed("name", "src").join(by_key(e), ["key", "src"]).groupBy("key", F.col("dst").alias("name")).agg(F.min("colour").alias("new"))
            frontier = checkpoint(colour.join(by_key(step), ["key", "name"]).filter("new < colour").select("key", "name", F.col("new").alias("colour")))
            if frontier.isEmpty():
                break
            colour = checkpoint(colour.unionByName(frontier).groupBy("key", "name").agg(F.min("colour").alias("colour")))
        of = lambda c: colour.select("key", F.col("name").alias(c), F.col("colour").alias(f"{c}_colour"))
        inner = checkpoint(e.join(by_key(of("src")), ["key", "src"]).join(by_key(of("dst")), ["key", "dst"]).filter("src_colour = dst_colour").select("key", "src", "dst"))
        found = frontier = colour.filter("name = colour").withColumnRenamed("colour", "label")
        while True:
            step = frontier.withColumnRenamed("name", "dst").join(by_key(inner), ["key", "dst"]).select("key", F.col("src").alias("name"), "label").distinct()
            frontier = checkpoint(step.join(by_key(found), ["key", "name"], "left_anti"))
            if frontier.isEmpty():
                break
            found = checkpoint(found.unionByName(frontier))
        labelled.append(found)
        gone = found.select("key", "name")
        e = checkpoint(inner.join(by_key(gone.withColumnRenamed("name", "src")), ["key", "src"], "left_anti").join(by_key(gone.withColumnRenamed("name", "dst")), ["key", "dst"], "left_anti"))
    known = _union(labelled) if labelled else every.withColumn("label", F.col("name")).limit(0)
    return every.join(by_key(known), ["key", "name"], "left").select("key", "name", F.coalesce("label", "name").alias("label"))


def strong_components(edges: DataFrame, small, checkpoint) -> DataFrame:
    """key, name, component (the least name in it), cyclic of the nodes at the ends of edges (key, src, dst)."""
    e = edges.select("key", "src", "dst").distinct()
    loops = e.filter("src = dst").select("key", F.col("src").alias("name"), F.lit(True).alias("loop"))
    weighted = checkpoint(e.filter("src <> dst").withColumn("w", F.lit(1).cast("long")))
    levels, core, _ = eliminate(weighted, small, checkpoint)
    known = checkpoint(_labels(core, small, checkpoint))
    for level in reversed(levels):
        # A neighbour that nothing has named stands for itself: it was left without edges.
        of = lambda side, c: side.join(by_key(known.withColumnRenamed("name", c)), ["key", c], "left").select("key", "name", F.coalesce("label", c).alias("label")).distinct()  # noqa: B023, E731
        here = level.ins.select("key", "name").unionByName(level.outs.select("key", "name")).distinct()
        # On a cycle if it leads from a component back to it, be that a single node.
        named = of(level.ins, "src").join(by_key(of(level.outs, "dst")), ["key", "name", "label"])
        known = _with(known, here.join(by_key(named), ["key", "name"], "left").select("key", "name", F.coalesce("label", "name").alias("label")), checkpoint)
    every = e.select("key", F.explode(F.array("src", "dst")).alias("name")).distinct()
    labelled = every.join(by_key(known), ["key", "name"], "left").select("key", "name", F.coalesce("label", "name").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(F.min("name").alias("component"), F.count("*").alias("n"))
    held = labelled.join(by_key(sizes), ["key", "label"]).join(by_key(loops), ["key", "name"], "left")
    return held.select("key", "name", "component", ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def _labels(core: DataFrame, small, checkpoint) -> DataFrame:
    """key, name, label: nodes of the core with the name of their strong component."""
    if not small(core):
        return _coloured(core, checkpoint)
    kind = dict(core.dtypes)["key"]
    return _cogrouped(core, core.select("key", F.col("src").alias("name")).limit(0), _tarjan, f"key {kind}, name string, label string")


def value_sets(edges: DataFrame, start: DataFrame, small, checkpoint, solve) -> tuple[DataFrame, DataFrame]:
    """(name, set) and (set, value): what nodes hold (key, name, value) and what flows to them along edges (key, src, dst),
    as one set for all nodes that have the same sources. No name is in two keys.

    Nodes go as in `eliminate` and push what they hold onwards; a core's circles are a node each, and their graph goes in the
    same way. A node that comes back has its own values and those of its neighbours by then: it gets the names of nodes
    whose values these are, not the values, so that what hangs on a circle has one name, be there ever so many values in it.
    solve(edges, held) follows values (node, value) in what no round takes out.
    """
    weighted = lambda df: df.filter("src <> dst").select("key", "src", "dst", F.lit(1).cast("long").alias("w"))
    outer, core, left = eliminate(weighted(edges), small, checkpoint, start, HELD)
    labels = checkpoint(_labels(core, small, checkpoint))
    of = lambda c: by_key(labels.select("key", F.col("name").alias(c), F.col("label").alias(f"{c}_label")))
    circles = checkpoint(core.join(of("src"), ["key", "src"]).join(of("dst"), ["key", "dst"]).select("key", F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).filter("src <> dst").distinct())
    placed = left.join(by_key(labels), ["key", "name"], "left").select("key", F.coalesce("label", "name").alias("name"), "value").distinct()
    inner, rest, last = eliminate(weighted(circles), lambda e: e.isEmpty(), checkpoint, checkpoint(placed), HELD)
    solved = checkpoint(solve(rest.select("key", "src", "dst"), last.select("key", F.col("name").alias("node"), "value")))
    held = checkpoint(_union([solved.select(F.col("node").alias("source"), "value"), *(level.start.select(F.concat(F.lit(f"{i}\t"), "name").alias("source"), "value") for i, level in enumerate(outer + inner))]))

    def back(known: DataFrame, levels: list[Level], first: int) -> DataFrame:
        for i, level in reversed(list(enumerate(levels, first))):
            via = level.ins.join(by_key(known.withColumnRenamed("name", "src")), ["key", "src"]).select("key", "name", "source")
            own = level.start.select("key", "name", F.concat(F.lit(f"{i}\t"), "name").alias("source"))
            known = _with(known, via.unionByName(own).distinct(), checkpoint)
        return known

    every = rest.select("key", F.explode(F.array("src", "dst")).alias("name")).unionByName(last.select("key", "name")).distinct()
    full = every.join(by_key(solved.select(F.col("node").alias("name")).distinct()), "name", "left_semi").select("key", "name", F.col("name").alias("source"))
    known = back(checkpoint(full), inner, len(outer))
    inside = labels.join(by_key(known.withColumnRenamed("name", "label")), ["key", "label"]).select("key", "name", "source")
    alone = known.join(by_key(labels.select("key", F.col("label").alias("name")).distinct()), ["key", "name"], "left_anti").select("key", "name", "source")
    known = back(checkpoint(inside.unionByName(alone)), outer, 0)
    nodes = checkpoint(known.groupBy("name").agg(F.sort_array(F.collect_set("source")).alias("sources")).select("name", F.sha2(F.to_json("sources"), 256).alias("set"), "sources"))
    parts = nodes.select("set", "sources").dropDuplicates(["set"]).select("set", F.explode("sources").alias("source"))
    return nodes.select("name", "set"), checkpoint(parts.join(by_key(held), "source").select("set", "value").distinct())
