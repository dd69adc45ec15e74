"""Values followed along the edges of graphs that fit a task each, written out as they are found: sets of nodes with sets of
values, so that pairs don't pass between Python and Spark."""

from __future__ import annotations

import functools
import heapq
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import by_key
from .hierarchy import _tarjan

#: Values times edges that a part of a graph's values may have, and the most parts.
WORK, PARTS = 100_000_000, 256
#: Rows that a part of a set's nodes and values makes.
ROWS = 2_000_000
#: Of a graph's circles so many, the largest, have what they lead to found once, if they have LEAST_HUB nodes.
HUBS, LEAST_HUB = 16, 16
#: Rows of a batch; one value's rows, a graph's nodes at most, stay together.
BATCH = 100_000
#: Sets are written in pieces of SIDE * SIDE pairs at most, as Spark holds the pairs of a piece at once.
SIDE = 64


class Graph:
    """Pairs of names as numbered nodes; hubs are the largest circles, and what a hub leads to is found once."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.number: dict[str, int] = {}
        self.after: list[list[int]] = []
        for pair in pairs:
            a, b = (self.number.setdefault(x, len(self.number)) for x in pair)
            self.after += ([] for _ in range(len(self.number) - len(self.after)))
            self.after[a].append(b)
        self.names = pa.array(list(self.number), pa.string())
        circles = defaultdict(list)
        for node, least in _tarjan({a: [(b, 1) for b in found] for a, found in enumerate(self.after)}, None):
            circles[least].append(node)
        self.hub: dict[int, int] = {}
        self.behind: list[tuple[np.ndarray, set[int]]] = []
        for members in heapq.nlargest(HUBS, circles.values(), key=len):
            if len(members) >= LEAST_HUB:
                own, hubs = self.reached(members[:1])
                found = np.concatenate([own, self.led(hubs)]) if hubs else own
                self.behind.append((found, set(found.tolist())))
                self.hub |= dict.fromkeys(members, len(self.behind) - 1)

    def reached(self, starts: list[int]) -> tuple[np.ndarray, frozenset[int]]:
        """Nodes that starts lead to, themselves too: those that no hub found on the way leads to, and these hubs."""
        found, hubs, passed = set(starts), set(), ()
        at = list(found)
        while at:
            a = at.pop()
            if a in self.hub:
                hubs.add(self.hub[a])
                passed = self.behind[self.hub[a]][1]
            elif a not in passed:
                new = [b for b in self.after[a] if b not in found]
                found.update(new)
                at += new
        for h in hubs:
            found = found - self.behind[h][1]
        return np.fromiter(found, np.int64, len(found)), frozenset(hubs)

    def led(self, hubs: frozenset[int]) -> np.ndarray:
        """Nodes that hubs lead to."""
        if len(hubs) == 1:
            return self.behind[next(iter(hubs))][0]
        return np.unique(np.concatenate([self.behind[h][0] for h in hubs]))


def _rows(graph: Graph, found: list[tuple[str | None, np.ndarray, frozenset[int]]]):
    """node, value of what was found, all of it among the nodes."""
    nodes = graph.names.take(pa.array(np.concatenate([x for _, x, _ in found])))
    values = pa.array([v for v, _, _ in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for _, x, _ in found])))
    yield pa.RecordBatch.from_arrays([nodes, values], names=["node", "value"])


def _sets(graph: Graph, found: list[tuple[str | None, np.ndarray, frozenset[int]]]):
    """nodes, values: each of the nodes has each of the values; what the same hubs lead to is found together."""
    shared = defaultdict(list)
    for value, _, hubs in found:
        if hubs:
            shared[hubs].append(value)
    rows, n = [], 0
    for nodes, held in itertools.chain(((graph.led(hubs), held) for hubs, held in shared.items()), ((own, [value]) for value, own, _ in found)):
        for k in range(0, len(held), SIDE):
            values = held[k : k + SIDE]
            step = SIDE * SIDE // len(values)
            for i in range(0, len(nodes), step):
                rows.append((nodes[i : i + step], values))
                n += len(rows[-1][0]) + len(values)
                if n >= BATCH:
                    yield _listed(graph, rows)
                    rows, n = [], 0
    if rows:
        yield _listed(graph, rows)


def _listed(graph: Graph, rows: list[tuple[np.ndarray, list[str | None]]]) -> pa.RecordBatch:
    places = lambda parts: pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    parts, held = zip(*rows)
    nodes = pa.ListArray.from_arrays(places(parts), graph.names.take(pa.array(np.concatenate(parts))))
    values = pa.ListArray.from_arrays(places(held), pa.array(itertools.chain.from_iterable(held), pa.string()))
    return pa.RecordBatch.from_arrays([nodes, values], names=["nodes", "values"])


def _follow(batches, sets: bool = False):
    """Rows (key, part, held, a, b) in order: a part's edges a -> b, then the nodes b that hold a value a.

    Gives (node, value), or with sets (nodes, values) of which all pairs are rows.
    """
    place, graph, pairs, value, starts, found, n = None, None, [], None, [], [], 0

    def reached():
        own, hubs = graph.reached(starts)
        if hubs and not sets:
            own, hubs = np.concatenate([own, graph.led(hubs)]), frozenset()
        return value, own, hubs

    pack = _sets if sets else _rows
    for batch in batches:
        for key, part, held, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, part) != place or held and a != value:
                if starts:
                    found.append(reached())
                    n += 1 + len(found[-1][1])
                    starts = []
                if found and (n >= BATCH or (key, part) != place):
                    yield from pack(graph, found)
                    found, n = [], 0
            if (key, part) != place:
                place, graph, pairs = (key, part), None, []
            if not held:
                pairs.append((a, b))
                continue
            if graph is None:
                graph, pairs = Graph(pairs), []
            value = a
            starts.append(graph.number[b])
    if starts:
        found.append(reached())
    if found:
        yield from pack(graph, found)


def values(edges: DataFrame, held: DataFrame) -> DataFrame:
    """node, value: what nodes hold (key, node, value) and what flows to them along edges (key, src, dst) of their key.

    The nodes of held are ends of edges, and none is in two keys. The edges of a key meet in one task, or in several that
    have a part of its values each, and are all that a task holds.
    """
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    sizes = count(edges, "n_edges").join(by_key(count(held, "n_held")), "key")
    parts = sizes.select("key", F.least(F.lit(PARTS), 1 + F.floor(F.col("n_edges") / WORK * F.col("n_held"))).cast("int").alias("parts"))
    copies = edges.join(by_key(parts), "key").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("held"), F.col("src").alias("a"), F.col("dst").alias("b"))
    dealt = held.join(by_key(parts), "key").select("key", F.pmod(F.xxhash64("value"), "parts").cast("int").alias("part"), F.lit(True).alias("held"), F.col("value").alias("a"), F.col("node").alias("b"))
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = copies.unionByName(dealt).repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "held", "a")
    found = rows.mapInArrow(functools.partial(_follow, sets=True), "nodes array<string>, values array<string>")
    # Python writes sets, and Spark all pairs of them.
    return found.select("nodes", F.explode("values").alias("value")).select(F.explode("nodes").alias("node"), "value")


def expand(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, value of nodes (name, set) and sets (set, value): a set of many rows is dealt to tasks by parts of its values."""
    count = lambda df, name: df.groupBy("set").agg(F.count("*").alias(name))
    sizes = count(nodes, "n_nodes").join(by_key(count(sets, "n_values")), "set")
    parts = sizes.select("set", F.least(F.lit(PARTS), F.col("n_values"), 1 + F.floor(F.col("n_nodes") / ROWS * F.col("n_values"))).cast("int").alias("parts"))
    copies = nodes.join(by_key(parts), "set").select("set", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("node"))
    dealt = sets.join(by_key(parts), "set").select("set", F.pmod(F.xxhash64("value"), "parts").cast("int").alias("part"), "value")
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return copies.repartition(tasks, "set", "part").join(by_key(dealt.repartition(tasks, "set", "part")), ["set", "part"]).select("node", "value")
