"""Iterative operators: reachability in its variants, peeling, components, closures.

Every operator takes an optional key column, so that all subsystems share the same rounds. Each has two ways. Where no
key has more edges than SMALL_EDGES, which is counted first, a key's edges and the nodes at their ends meet in one task
and a linear-time algorithm runs over them; keys run in parallel, and nodes without edges stay where they are. Beyond
that, rounds of joins run over the distributed edges, with a checkpoint each. Reach, peeling and cycles go by elimination
hierarchies (`hierarchy.py`), whose rounds grow with the logarithm of a path's length; components by contraction, also in
a logarithm of rounds. Values and closures follow each component of the graph in tasks of its own, where it has
SMALL_EDGES edges at most, and by hierarchies where it has more. Joins are by key, so that no table goes through the driver.
"""

from __future__ import annotations

import functools
from collections import defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import by_key, checkpoint
from . import follow, hierarchy

#: About 100 MB of names in one task.
SMALL_EDGES = 500_000
#: Components are found in arrays, which hold so many times the edges in the same memory.
ARRAYS = 4
HOPS = 3
#: Values follow edges up to here without a look at the graph's components.
WHOLE_EDGES = 20_000


def _keyed(df: DataFrame, key: str | None, *columns: str) -> DataFrame:
    return df.select((F.col(key) if key else F.lit(0)).alias("key"), *columns).distinct()


def is_small(edges: DataFrame, most: int) -> bool:
    """Whether no key has more than `most` edges."""
    return (edges.groupBy("key").count().agg(F.max("count")).first()[0] or 0) <= most


def _local(edges: DataFrame, others: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """kernel(successors, rows of others) for each key; a key without edges has no successors."""

    def run(e: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        after = defaultdict(list)
        for a, b in zip(e["src"], e["dst"]):
            after[a].append(b)
        rows = kernel(after, o)
        key = (e if len(e) else o)["key"]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][1:])
        out.insert(0, "key", key.iloc[0] if len(key) else None)
        return out

    return edges.groupBy("key").cogroup(others.groupBy("key")).applyInPandas(run, schema)


def _touched(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Rows of nodes (key, name, ...) whose node is at the end of an edge (left_semi) or of none (left_anti)."""
    ends = edges.select("key", F.explode(F.array("src", "dst")).alias("name")).distinct()
    return nodes.join(by_key(ends), ["key", "name"], how)


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _schema(edges: DataFrame, columns: str) -> str:
    return f"key {dict(edges.dtypes)['key']}, {columns}"


def _renamed(df: DataFrame, key: str | None) -> DataFrame:
    return df.withColumnRenamed("key", key) if key else df.drop("key")


def reach(edges: DataFrame, seeds: DataFrame, key: str | None = None, through: DataFrame | None = None, most_depth: int | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """[key,] name, depth: nodes at the end of paths of one edge or more from seeds ([key,] name), shortest first.

    With `through` (name), a path only goes on behind nodes that are in it, and seeds are no results. With most_depth,
    paths have that many edges at most. A seed is a result if a path leads back to it.
    """
    e, s = _keyed(edges, key, "src", "dst"), _keyed(seeds, key, "name")
    if through is not None:
        guard = through.select("name").distinct().withColumn("guard", F.lit(True))
        e = e.join(by_key(s.select("key", F.col("name").alias("dst"))), ["key", "dst"], "left_anti")
        start = e.join(by_key(s.select("key", F.col("name").alias("src"))), ["key", "src"], "left_semi")
        inner = e.join(by_key(guard.select(F.col("name").alias("src"))), "src", "left_semi").select("key", "src", "dst")
        e = inner.unionByName(start.select("key", "src", "dst")).distinct()
    if is_small(e, small_edges):
        kinds = _schema(e, "name string, depth int")

        def walk(after, o):
            at, depth, found = list(o["name"]), 0, {}
            while at and (most_depth is None or depth < most_depth):
                depth += 1
                new = []
                for a in at:
                    for b in after.get(a, ()):
                        if b not in found:
                            found[b] = depth
                            new.append(b)
                at = new
            return list(found.items())

        return _renamed(_local(e, s.join(by_key(e.select("key", F.col("src").alias("name")).distinct()), ["key", "name"], "left_semi"), walk, kinds), key)
    if most_depth is None:
        start = s.withColumnRenamed("name", "src").join(by_key(e), ["key", "src"]).select("key", F.col("dst").alias("name"), F.lit(1).cast("long").alias("d"))
        found = hierarchy.distances(e.withColumn("w", F.lit(1).cast("long")), start, functools.partial(is_small, most=small_edges), checkpoint)
        return _renamed(found.select("key", "name", F.col("d").cast("int").alias("depth")), key)
    frontier, depth = s, 0
    found: list[DataFrame] = []
    while depth < most_depth:
        hops: list[DataFrame] = []
        for _ in range(min(HOPS, most_depth - depth)):
            depth += 1
            frontier = frontier.select("key", F.col("name").alias("src")).join(by_key(e), ["key", "src"]).select("key", F.col("dst").alias("name")).distinct()
            hops.append(frontier.withColumn("depth", F.lit(depth)))
        new = _union(hops).groupBy("key", "name").agg(F.min("depth").alias("depth"))
        new = checkpoint(new.join(by_key(_union(found)), ["key", "name"], "left_anti") if found else new)
        if new.isEmpty():
            break
        found.append(new)
        # Nodes found at an earlier hop of this round have been followed already, but for the last hop's.
        frontier = new.filter(F.col("depth") == depth).select("key", "name")
    return _renamed(_union(found) if found else s.limit(0).withColumn("depth", F.lit(0)), key)


def strong_components(edges: DataFrame, key: str | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """[key,] name, component (the least name that is on a cycle with it, or its own), cyclic (whether it is on one)."""
    e = checkpoint(_keyed(edges, key, "src", "dst"))
    return _renamed(hierarchy.strong_components(e, functools.partial(is_small, most=small_edges), checkpoint), key)


def peel(edges: DataFrame, nodes: DataFrame, keep: DataFrame | None = None, key: str | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """[key,] name: nodes that go when nodes without edges into them are removed, again and again.

    What remains is on a cycle, behind one, or in `keep` ([key,] name) or behind that.
    """
    e, n = checkpoint(_keyed(edges, key, "src", "dst")), _keyed(nodes, key, "name")
    kept = _keyed(keep, key, "name") if keep is not None else n.limit(0)
    if keep is not None and not is_small(e, small_edges):
        e, kept = _undecided(e, kept, small_edges)
    n = n.join(by_key(kept.withColumn("fixed", F.lit(True))), ["key", "name"], "left").select("key", "name", F.coalesce("fixed", F.lit(False)).alias("fixed"))
    if is_small(e, small_edges):

        def kahn(after, o):
            into: dict = defaultdict(int)
            for found in after.values():
                for b in found:
                    into[b] += 1
            at = deque(a for a, f in zip(o["name"], o["fixed"]) if not f and not into[a])
            movable = set(o["name"][~o["fixed"].astype(bool)]) if len(o) else set()
            out = []
            while at:
                a = at.popleft()
                out.append((a,))
                for b in after.get(a, ()):
                    into[b] -= 1
                    if not into[b] and b in movable:
                        at.append(b)
            return out

        alone = _touched(e, n, "left_anti").filter("not fixed").select("key", "name")
        return _renamed(_local(e, _touched(e, n, "left_semi"), kahn, _schema(e, "name string")).unionByName(alone), key)
    few = functools.partial(is_small, most=small_edges)
    cyclic = hierarchy.strong_components(e, few, checkpoint).filter("cyclic").select("key", "name")
    held = checkpoint(cyclic.unionByName(n.filter("fixed").select("key", "name")).distinct())
    start = held.withColumnRenamed("name", "src").join(by_key(e), ["key", "src"]).select("key", F.col("dst").alias("name"), F.lit(1).cast("long").alias("d"))
    behind = hierarchy.distances(e.withColumn("w", F.lit(1).cast("long")), start, few, checkpoint).select("key", "name")
    return _renamed(n.select("key", "name").join(by_key(held.unionByName(behind).distinct()), ["key", "name"], "left_anti"), key)


def _undecided(e: DataFrame, kept: DataFrame, small_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges without those into nodes that stay, which decide nothing, and the nodes that stay: kept ones and what they lead
    to, as long as a fifth of the edges goes."""
    kept, before = checkpoint(kept), e.count()
    while True:
        e = checkpoint(e.join(by_key(kept.withColumnRenamed("name", "dst")), ["key", "dst"], "left_anti").select("key", "src", "dst"))
        behind = e.join(by_key(kept.withColumnRenamed("name", "src")), ["key", "src"], "left_semi").select("key", F.col("dst").alias("name"))
        kept, after = checkpoint(kept.unionByName(behind).distinct()), e.count()
        if 5 * after > 4 * before or is_small(e, small_edges):
            return e, kept
        before = after


def components(edges: DataFrame, nodes: DataFrame, key: str | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """[key,] name, component: the least name that edges, whatever their direction, lead to; alone, the node itself."""
    e, n = checkpoint(_keyed(edges, key, "src", "dst")), _keyed(nodes, key, "name")
    classes = _classes(e, small_edges)
    return _renamed(n.join(by_key(classes), ["key", "name"], "left").select("key", "name", F.coalesce("component", "name").alias("component")), key)


def _least(edges: pa.Table) -> pa.Table:
    """key, name, component of the ends of one key's edges: in each round all but the least of neighbours go into a lesser one."""
    both = pa.chunked_array(edges["src"].chunks + edges["dst"].chunks, edges["src"].type).combine_chunks().dictionary_encode()
    names = both.dictionary
    order = np.asarray(pc.array_sort_indices(names))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    a, b = np.split(rank[np.asarray(both.indices)], 2)
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    key = edges["key"].combine_chunks().take(pa.array(np.zeros(len(names), np.int64)))
    return pa.table({"key": key, "name": names, "component": names.take(pa.array(order[root[rank]]))})


def _classes(e: DataFrame, small_edges: int) -> DataFrame:
    """key, name, component of the ends of edges (key, src, dst) between different nodes."""
    one = lambda rest: rest.groupBy("key").applyInArrow(_least, _schema(rest, "name string, component string"))
    rest, maps = e.filter("src <> dst"), []
    while not rest.isEmpty() and not is_small(rest, ARRAYS * small_edges):
        # Each node goes into the one of least rank among itself and its neighbours, ranks being drawn anew in each round.
        end = lambda a, b: F.struct(F.col(a).alias("name"), F.struct(F.xxhash64("key", b, F.lit(len(maps))).alias("rank"), F.col(b).alias("name")).alias("near"))  # noqa: B023, E731
        pairs = rest.select("key", F.explode(F.array(end("src", "dst"), end("dst", "src"), end("src", "src"), end("dst", "dst"))).alias("end")).select("key", "end.*")
        maps.append(checkpoint(pairs.groupBy("key", "name").agg(F.min("near").alias("near")).select("key", "name", F.col("near.name").alias("root"))))
        to = lambda c: by_key(maps[-1].select("key", F.col("name").alias(c), F.col("root").alias(f"{c}_root")))
        moved = rest.join(to("src"), ["key", "src"]).join(to("dst"), ["key", "dst"]).filter("src_root <> dst_root")
        rest = checkpoint(moved.select("key", F.least("src_root", "dst_root").alias("src"), F.greatest("src_root", "dst_root").alias("dst")).distinct())
    if not maps:
        return one(rest)
    known = one(rest).withColumnRenamed("component", "root")
    for level in reversed(maps):
        above = known.select("key", F.col("name").alias("root"), F.col("root").alias("top"))
        known = checkpoint(level.join(by_key(above), ["key", "root"], "left").select("key", "name", F.coalesce("top", "root").alias("root")))
    least = known.groupBy("key", "root").agg(F.min("name").alias("component"))
    return known.join(by_key(least), ["key", "root"]).select("key", "name", "component")


def closure(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """src, dst of all paths of one edge or more: what the ends of a node's edges lead to, as in `spread`."""
    kinds = dict(edges.dtypes)
    e = checkpoint(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct())
    found = _spread(e.filter("src <> dst"), e.select(F.col("dst").alias("node"), F.col("src").alias("value")), small_edges)
    return found.select(F.col("value").cast(kinds["src"]).alias("src"), F.col("node").cast(kinds["dst"]).alias("dst"))


def spread(edges: DataFrame, held: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """node, value: what nodes hold (node, value) and what flows to them along edges (src, dst), strings all.

    No pairs of nodes are made: rows are those of the result. Each component of the graph goes to tasks of its own, which
    follow the nodes of a part of the values each and write rows as they find them; components of more edges than
    small_edges lose the edges along which nothing flows, and what stays as large goes by `hierarchy.value_sets`.
    """
    return _spread(checkpoint(edges.select("src", "dst").filter("src <> dst").distinct()), held.select("node", "value").distinct(), small_edges)


def _spread(e: DataFrame, own: DataFrame, small_edges: int) -> DataFrame:
    """`spread` of edges that are written down, each once, and rows of nodes that are different."""
    if is_small(e.withColumn("key", F.lit(0)), min(small_edges, WHOLE_EDGES)):
        ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        at = checkpoint(own.join(by_key(ends.withColumn("key", F.lit(""))), "node", "left").select("key", "node", "value"))
        return _union([at.filter("key is null").select("node", "value"), follow.values(e.withColumn("key", F.lit("")), at.filter("key is not null"))])
    keyed, moving, alone = _placed(e, own, small_edges)
    out = [alone]
    if not is_small(keyed, small_edges):
        large = checkpoint(keyed.groupBy("key").count().filter(F.col("count") > small_edges).select("key"))
        few = [df.join(by_key(large), "key", "left_anti") for df in (keyed, moving)]
        rest, held = (df.join(by_key(large), "key", "left_semi") for df in (keyed, moving))
        out.append(follow.values(*few))
        keyed, moving, alone = _placed(*_flowing(rest, held), small_edges)
        out.append(alone)
    if is_small(keyed, small_edges):
        return _union([*out, follow.values(keyed, moving)])
    large = checkpoint(keyed.groupBy("key").count().filter(F.col("count") > small_edges).select("key"))
    out.append(follow.values(keyed.join(by_key(large), "key", "left_anti"), moving.join(by_key(large), "key", "left_anti")))
    inside = [checkpoint(df.join(by_key(large), "key", "left_semi")) for df in (keyed, moving)]
    return _union([*out, follow.expand(*_value_sets(*inside, small_edges))])


def _placed(e: DataFrame, own: DataFrame, small_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (key, src, dst) and what their nodes hold (key, node, value) by component, and the rows (node, value) of nodes
    without edges."""
    places = checkpoint(_classes(e.withColumn("key", F.lit(0)), small_edges)).select("name", F.col("component").alias("key"))
    at = checkpoint(own.join(by_key(places.withColumnRenamed("name", "node")), "node", "left").select("key", "node", "value"))
    keyed = checkpoint(e.join(by_key(places.withColumnRenamed("name", "src")), "src").select("key", "src", "dst"))
    return keyed, at.filter("key is not null"), at.filter("key is null").select("node", "value")


def _flowing(edges: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges along which something may flow, and what nodes hold: no edges from nodes that hold nothing and that no edge
    leads to, as long as a fifth of them goes."""
    own = checkpoint(held.select("node", "value").distinct())
    holding = own.select(F.col("node").alias("src"))
    e = checkpoint(edges.select("src", "dst").filter("src <> dst").distinct())
    while True:
        kept = checkpoint(e.join(by_key(holding.unionByName(e.select(F.col("dst").alias("src"))).distinct()), "src", "left_semi").select("src", "dst"))
        before, after = e.count(), kept.count()
        e = kept
        if 5 * after > 4 * before or after <= WHOLE_EDGES:
            return e, own


def _value_sets(keyed: DataFrame, moving: DataFrame, small_edges: int) -> tuple[DataFrame, DataFrame]:
    """(name, set) and (set, value) of edges (key, src, dst) and what their nodes hold (key, node, value)."""
    few = functools.partial(is_small, most=small_edges)

    def solve(rest: DataFrame, held: DataFrame) -> DataFrame:
        ends = checkpoint(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        alone, found = held.join(by_key(ends), "node", "left_anti").select("node", "value"), [checkpoint(held.join(by_key(ends), "node", "left_semi"))]
        if few(rest):
            return alone.unionByName(follow.values(rest, found[0]))
        found[0] = found[0].select("node", "value")
        while True:
            step = found[-1].withColumnRenamed("node", "src").join(by_key(rest), "src").select(F.col("dst").alias("node"), "value").distinct()
            new = checkpoint(step.subtract(_union(found)))
            if new.isEmpty():
                return _union([alone, *found])
            found.append(new)

    return hierarchy.value_sets(keyed, moving.withColumnRenamed("node", "name"), few, checkpoint, solve)


def spread_sets(edges: DataFrame, held: DataFrame, small_edges: int = SMALL_EDGES) -> tuple[DataFrame, DataFrame]:
    """(node, set) and (set, value): the rows of `spread` by sets that nodes share, as long as the nodes and the sets."""
    e, own = _flowing(edges, held)
    if is_small(e.withColumn("key", F.lit(0)), min(small_edges, WHOLE_EDGES)):
        each = checkpoint(spread(e, own, small_edges).groupBy("node").agg(F.sort_array(F.collect_set("value")).alias("values")).select("node", F.sha2(F.to_json("values"), 256).alias("set"), "values"))
        return each.select("node", "set"), each.select("set", "values").dropDuplicates(["set"]).select("set", F.explode("values").alias("value"))
    nodes, sets = _value_sets(e.withColumn("key", F.lit("")), own.withColumn("key", F.lit("")), small_edges)
    return nodes.withColumnRenamed("name", "node"), sets


def acyclic_closure(inner: DataFrame, direct: DataFrame) -> DataFrame:
    """key, value: direct values (key, value) of a node and, if no cycle can be reached from it, of all it reaches.

    inner (src, dst) are the edges between keys. Nodes on cycles or with a way into one keep their direct values.
    """
    e = inner.select("src", "dst").distinct()
    every = e.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    settled = peel(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), every)
    open_ = e.join(by_key(settled.select(F.col("name").alias("src"))), "src", "left_semi")
    back = open_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return spread(back, direct.select(F.col("key").alias("node"), "value")).select(F.col("node").alias("key"), "value")


def expand_inline(edges: DataFrame, start: DataFrame, inline: DataFrame, stop: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """Names that aren't inline, reached from `start` by replacing inline names by their callees outside `stop`.

    A cycle of inline functions has nothing to be replaced by and gives nothing.
    """
    allowed = edges.join(inline.select(F.col("name").alias("src")), "src", "left_semi").join(stop.select(F.col("name").alias("dst")), "dst", "left_anti")
    found = reach(allowed, start, small_edges=small_edges).select("name")
    return start.select("name").unionAll(found).distinct().join(inline.select("name"), "name", "left_anti")
