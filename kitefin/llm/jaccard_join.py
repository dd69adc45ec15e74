"""Exact Jaccard join of documents' shingle sets as a metric-space join.

The Jaccard distance is a metric; let r be the threshold's distance. Unrelated texts are all at distance 1 from one
another, so that pivots alone can't tell them apart: a Voronoi partition by a few pivots would replicate every document
into every region. The first regions are therefore by content. The shingle universe is cut into parts; two sets that
differ in D shingles agree on one of any D + 1 parts, so linked sets meet in a region (part, what the set has there),
and D follows from the threshold and the sizes (`most_different`). Shingles that very many documents share are left out
of the parts, which keeps the argument and avoids crowded regions; sets that lack parts then use all their shingles in
further regions. Regions of the same sets are one region.

1. Voronoi cells, recursively (`_cells`). Each region's pivot is the set that shares most regions with others. Sets get
   their exact distances to the pivots they meet. A set joins the cell of its nearest pivot if that is within r (so
   a cell's sets are all linked through the pivot); the rest of a region is a smaller region with new pivots. What no
   round takes in is a cell of its own.
2. Cells that meet in a region, not yet in one component: a link between a set of the cell of p and one of q needs
   d(p, q) <= r + the radii of both cells. Pivots that are so near are measured.
3. Windows. A set x of p can only link into q's cell if d(p, q) - d(x, p) <= r + q's radius: these boundary sets are
   replicated to q and measured against it, and the other way round. Of what the distances then allow (x and y differ by
   r at most in their distances to p and to q), x and y are compared themselves.

No step depends on the one before having found all it could: what a step leaves, the next looks at. Pairs already in one
component are left out, as only components are asked for. A pair is measured once in a step, however many regions the two
share, and only if sketches don't rule its distance out. Each join makes rows for pairs near enough alone.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, moved, shared_dir, stage, text_groups, text_key

SHINGLE = 4
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 85
BAND_RATIO, LEAST_BAND = 1.5, 6
#: Rounds in which the sets of a region that are in no cell yet get new pivots.
PIVOT_ROUNDS = 2
#: Documents that are looked at to find very common shingles, how often one must be in them, and how many are kept.
#: They only choose which regions are made; whatever they are, no link is lost.
SAMPLE_DOCS, SAMPLE_HITS, MOST_COMMON = 16_000, 8, 200_000
SKETCH_BITS = 1024
#: Orders of the regions in which two cells look for a region that stands for all that both are in.
ORDERS = 8
#: Over any rounding of a distance.
TINY = 1e-9
#: Of a graph whose components one task finds.
SMALL_EDGES = 500_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_S = {k: np.uint64(k) for k in (27, 30, 31, 32)}
#: Hashes of words that a worker remembers.
MOST_WORDS = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[30])) * _M[1]
    x = (x ^ (x >> _S[27])) * _M[2]
    return x ^ (x >> _S[31])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, words: int = SHINGLE):
        self.words, self.known = words, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > MOST_WORDS:
            self.known = _Words()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ (out >> _S[31])) * _M[k % 4] + h[k : len(h) - n + 1 + k]
        out = np.sort(mix(out))
        return out[np.r_[True, out[1:] != out[:-1]]]


def set_id(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def most_different(a: int, low: int, high: int, percent: int = PERCENT) -> int:
    """The greatest symmetric difference of a set of a shingles and a linked one of low to high; -1 if none can link."""
    b = np.arange(max(low, -(-percent * a // 100)), min(high, 100 * a // percent) + 1)
    common = -(-percent * (a + b) // (100 + percent))
    possible = common <= np.minimum(a, b)
    return int((a + b - 2 * common)[possible].max(initial=-1))


@functools.lru_cache(100_000)
def bands(n: int, percent: int = PERCENT) -> tuple[tuple[int, int, int], ...]:
    """(band, parts, greatest difference) of the size bands in which a set of n shingles may have partners as large."""
    out, low, band = [], LEAST_BAND - 1, 0
    while low < 100 * n // percent:
        high = int(low * BAND_RATIO) + 1
        # In its own band a set may have smaller partners, from below the band too.
        if n <= high and (d := most_different(n, low + 1 if n <= low else 1, high, percent)) > 0:
            parts = int(1.25 * (2 * high * (100 - percent) / (100 + percent) * 1.09 + 2)) + 4
            out.append((band, parts, d))
        low, band = high, band + 1
    return tuple(out)


def regions(shingles: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the regions of a set: for each band, enough parts that two linked sets share one."""
    out = []
    places = np.searchsorted(common, shingles)
    places[places == len(common)] = 0
    rare = shingles[common[places] != shingles] if len(common) else shingles
    for band, parts, d in bands(len(shingles), percent):
        for layer, chosen in enumerate((rare, shingles)):
            seed = np.uint64(band * 4 + layer)
            if len(chosen):
                part = (chosen >> _S[32]) * np.uint64(parts) >> _S[32]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])[: d + 1]
                end = int(np.searchsorted(part, part[first[-1]], "right"))
                held = np.add.reduceat(mix(chosen[:end] ^ _M[3]), first)
                out.append(mix(held + mix(part[first] * _M[0] + seed)))
                if len(first) > d:
                    break  # any linked set shares one of these, if it has any region of this layer
            if layer:
                out.append(mix(np.array([seed | np.uint64(2)]) * _M[3] + _M[0]))  # what has too few parts meets here
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


WORDS = SKETCH_BITS // 64
_SKETCH = tuple(f"s_{k}" for k in range(WORDS))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each of SKETCH_BITS places: two sketches differ no more than their sets do."""
    odd = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profiles(shared, shingle: int, percent: int):
    """What is known of each text: set size, set id and regions."""

    def run(batches):
        shingler, common = Shingler(shingle), np.frombuffer(shared.value, np.uint64)
        for batch, texts in text_groups(batches):
            sets = [shingler(t) for t in texts]
            keys = [regions(s, common, percent) for s in sets]
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), held]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "row_key")), *columns], names=["doc_id", "text_key", "row_key", "n", "sid", "regions"])

    return run


def _shingles(shingle: int):
    def run(batches):
        shingler = Shingler(shingle)
        for _, texts in text_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingler(t) for t in texts]).view(np.int64))], names=["shingle"])

    return run


def _sets(shingle: int):
    """Sets of the texts whose id is the row's, with sizes and sketches."""

    def run(batches):
        shingler = Shingler(shingle)
        for batch, texts in text_groups(batches):
            found = [(i, s) for i, s in zip(batch.column("sid").to_pylist(), map(shingler, texts)) if set_id(s) == i]
            if not found:
                continue
            ids, sets = zip(*found)
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            sketches = np.stack([sketch(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), held, *(pa.array(sketches[:, k]) for k in range(WORDS))], names=["sid", "n", "shingles", *_SKETCH])

    return run


def _union_find(batches):
    root: dict[int, int] = {}

    def top(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = a = root[root[a]]
        return a

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([top(a) for a in list(root)], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the undirected graph of edges (a, b); nodes without edges are absent.

    Up to SMALL_EDGES edges, one task; beyond, large-star and small-star steps in turn, until all are stars.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(edges.select("a", "b").filter("a <> b").distinct())
    if edges.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, component long")
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("m", "a").alias("m"))
        large = stage(near.filter("b > a").join(least, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "x")
        small = down.join(least, F.col("a") == F.col("x"))
        after = stage(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("x").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        # Done when every node but the least points at the least alone.
        tops = after.select(F.col("b").alias("top")).distinct()
        if after.join(tops, F.col("a") == F.col("top"), "left_semi").isEmpty() and after.groupBy("a").count().filter("count > 1").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select(F.col("top").alias("node"), F.col("top").alias("component")))
        edges = after


def _near(a: str, b: str, most: Column) -> Column:
    """Whether sizes and sketches (columns a_n, a_s_0, a_s_1, ...) let two sets be at a distance of `most` or less: exact
    the one way. The difference D of sets of m and n shingles is at least that of their sketches, and their distance is
    2 D / (m + n + D)."""
    differ = functools.reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in _SKETCH))
    m, n = F.col(f"{a}_n"), F.col(f"{b}_n")
    sizes = F.least(m, n) >= F.greatest(m, n) * (1 - most - TINY)
    return sizes & (differ * (2 - most) <= (most + TINY) * (m + n))


def _sketched(df: DataFrame, sets: DataFrame, column: str, name: str) -> DataFrame:
    """df with the size and the sketch of the set in a column as name_n, name_s_0, name_s_1, ..."""
    known = sets.select(F.col("sid").alias(f"{name}_sid"), *(F.col(c).alias(f"{name}_{c}") for c in ("n", *_SKETCH)))
    return df.join(known, F.col(column) == F.col(f"{name}_sid")).drop(f"{name}_sid")


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Staged pairs (pivot, sid), each once, with common and joint (the sizes of intersection and union) and distance."""
    one, two = (sets.select(F.col("sid").alias(f"{k}_sid"), F.col("shingles").alias(k)) for k in ("one", "two"))
    held = pairs.select("pivot", "sid").join(one, F.col("sid") == F.col("one_sid")).join(two, F.col("pivot") == F.col("two_sid"))
    counted = held.select("pivot", "sid", F.size(F.array_intersect("one", "two")).cast("long").alias("common"), (F.size("one") + F.size("two")).cast("long").alias("both"))
    return stage(counted.select("pivot", "sid", "common", (F.col("both") - F.col("common")).alias("joint"), (1 - F.col("common") / (F.col("both") - F.col("common"))).alias("distance")))


def common_shingles(documents: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Shingles that many documents share, from a bounded sample; they only choose which regions are made."""
    share = max(1, documents.count() // SAMPLE_DOCS)
    sampled = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    often = sampled.select("text").mapInArrow(_shingles(shingle), "shingle long").groupBy("shingle").count().filter(F.col("count") >= SAMPLE_HITS)
    return np.sort(np.array([r.shingle for r in often.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))


def _once(rows: DataFrame) -> DataFrame:
    """rows (region, sid) of one region of those with the same sets (by two 64-bit digests), and how many those are."""
    each = rows.groupBy("region").agg(F.count("*").alias("members"), *(F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"digest_{k}") for k in (1, 2)))
    kept = each.groupBy("members", "digest_1", "digest_2").agg(F.min("region").alias("k_region"), F.count("*").alias("times"))
    return rows.join(kept.select("k_region", "times"), F.col("region") == F.col("k_region")).select("region", "sid", "times")


def _of(classes: DataFrame, name: str, as_: str) -> DataFrame:
    return classes.select(F.col("node").alias(name), F.col("component").alias(as_))


def _apart(pairs: DataFrame, classes: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose sets in columns a and b aren't known to be in one component."""
    held = pairs.join(_of(classes, "a_node", "a_class"), F.col(a) == F.col("a_node"), "left").join(_of(classes, "b_node", "b_class"), F.col(b) == F.col("b_node"), "left")
    return held.filter(F.coalesce("a_class", a) != F.coalesce("b_class", b)).select(*pairs.columns)


def _links(measured: DataFrame, percent: int) -> DataFrame:
    return measured.filter(f"100 * common >= {percent} * joint")


def _cells(shared: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sid, cell, distance) of sets within the threshold of a pivot and of pivots; all links found (pivot, sid).

    shared: region, sid, score, sizes and sketches; of what is left of a region, the set of the highest score is the pivot.
    """
    cells, links, todo = [], [], shared
    columns = ("n", *_SKETCH)
    for _ in range(PIVOT_ROUNDS):
        heads = todo.groupBy("region").agg(F.max(F.struct("score", "sid", *(f"a_{c}" for c in columns))).alias("head"), F.count("*").alias("members")).filter("members > 1")
        heads = stage(heads.select(F.col("region").alias("h_region"), F.col("head.sid").alias("pivot"), *(F.col(f"head.a_{c}").alias(f"b_{c}") for c in columns)))
        met = todo.join(heads, (F.col("region") == F.col("h_region")) & (F.col("sid") != F.col("pivot")) & _near("a", "b", F.lit((100 - percent) / 100)))
        # Each pair is measured once, even if both are pivots.
        pairs = met.groupBy(F.least("sid", "pivot").alias("low"), F.greatest("sid", "pivot").alias("high")).agg(F.max("pivot").alias("pivot"))
        pairs = stage(pairs.select("pivot", F.when(F.col("pivot") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("sid")))
        linked = _links(_measure(pairs, sets), percent)
        links.append(linked.select("pivot", "sid"))
        # A pivot is nearest to itself.
        homes = linked.select("sid", F.col("pivot").alias("cell"), "distance").unionByName(heads.select(F.col("pivot").alias("sid"), F.col("pivot").alias("cell"), F.lit(0.0).alias("distance")))
        homes = homes.groupBy("sid").agg(F.min(F.struct("distance", "cell")).alias("home"))
        cells.append(stage(homes.select("sid", F.col("home.cell").alias("cell"), F.col("home.distance").alias("distance"))))
        if len(cells) == PIVOT_ROUNDS or linked.isEmpty():
            break
        todo = stage(todo.join(cells[-1].select(F.col("sid").alias("t_sid")), F.col("sid") == F.col("t_sid"), "left_anti"))
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(cells), union(links)


def _with_links(links: DataFrame, measured: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """links and classes with those of measured pairs."""
    new = _links(measured, percent).select("pivot", "sid")
    if new.isEmpty():
        return links, classes
    links = links.unionByName(new)
    return links, stage(components(links.toDF("a", "b")))


def link_sets(profiles: DataFrame, documents: DataFrame, repeated_keys: bool = True, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """node, component over the ids of different sets that have links. documents: row_key, text; profiles of them."""
    r = (100 - percent) / 100
    placed = profiles.select(F.explode("regions").alias("region"), "sid")
    crowded = placed.groupBy("region").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low < high").select(F.col("region").alias("c_region"))
    # Staged, so that the join deals both sides anew and Spark can split a region that is in every second set.
    crowded = stage(crowded)
    shared = stage(placed.join(crowded, F.col("region") == F.col("c_region"), "left_semi").distinct())
    found = stage(_once(shared))
    drop(crowded, shared)
    # The sets of all that share a region, from one row each. A row key that two rows share is told by the set's id.
    scores = found.groupBy(F.col("sid").alias("s_sid")).agg(F.sum("times").alias("score"))
    first = profiles.groupBy("sid").agg(F.min("row_key").alias("f_key")).join(scores.select("s_sid"), F.col("sid") == F.col("s_sid"), "left_semi").withColumnRenamed("sid", "f_sid")
    sets = documents.join(moved(stage(first)), F.col("row_key") == F.col("f_key")).select(F.col("f_sid").alias("sid"), "text")
    sets = sets.mapInArrow(_sets(shingle), "sid long, n long, shingles array<long>, " + ", ".join(f"{c} long" for c in _SKETCH))
    sets = stage(sets.dropDuplicates(["sid"]) if repeated_keys else sets)
    drop(profiles)
    wide = stage(_sketched(found.join(scores, F.col("sid") == F.col("s_sid")).select("region", "sid", "score"), sets, "sid", "a"))
    homes, links = _cells(wide, sets, percent)
    classes = stage(components(links.toDF("a", "b")))
    homes = stage(sets.select("sid").join(homes.withColumnRenamed("sid", "h_sid"), F.col("sid") == F.col("h_sid"), "left").select("sid", F.coalesce("cell", "sid").alias("cell"), F.coalesce("distance", F.lit(0.0)).alias("distance")))
    # Cells that meet, as far as no path joins them.
    radii = homes.groupBy("cell").agg(F.max("distance").alias("radius")).join(_of(classes, "node", "class"), F.col("cell") == F.col("node"), "left")
    known = _sketched(radii.select(F.col("cell").alias("k_cell"), "radius", F.coalesce("class", "cell").alias("class")), sets, "k_cell", "a")
    met = stage(found.join(homes.select(F.col("sid").alias("h_sid"), "cell"), F.col("sid") == F.col("h_sid")).select("region", "cell").distinct())
    leasts = met.groupBy(F.col("cell").alias("l_cell")).agg(*(F.min_by("region", F.xxhash64("region", F.lit(k))).alias(f"a_least_{k}") for k in range(ORDERS)))
    met = stage(met.join(known.join(leasts, F.col("k_cell") == F.col("l_cell")), F.col("cell") == F.col("k_cell")).drop("k_cell", "l_cell"))
    other = met.select(F.col("region").alias("o_region"), F.col("cell").alias("other"), F.col("class").alias("o_class"), F.col("radius").alias("o_radius"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in ("n", *_SKETCH)), *(F.col(f"a_least_{k}").alias(f"b_least_{k}") for k in range(ORDERS)))
    # In one of the regions that both are in, if they have the same least region by some order; else in all.
    here = F.lit(True)
    for k in reversed(range(ORDERS)):
        here = F.when(F.col(f"a_least_{k}") == F.col(f"b_least_{k}"), F.col("region") == F.col(f"a_least_{k}")).otherwise(here)
    reach = F.lit(r) + F.col("radius") + F.col("o_radius")
    pairs = met.join(other, (F.col("region") == F.col("o_region")) & (F.col("cell") < F.col("other")) & (F.col("class") != F.col("o_class")) & here & _near("a", "b", reach))
    pairs = stage(pairs.select(F.col("cell").alias("pivot"), F.col("other").alias("sid"), "radius", "o_radius").distinct())
    drop(found, wide)
    measured = _measure(pairs, sets)
    links, classes = _with_links(links, measured, classes, percent)
    # Windows: boundary sets go to the other cell's pivot.
    radius = pairs.filter("radius > 0 or o_radius > 0").select(F.col("pivot").alias("w_pivot"), F.col("sid").alias("w_sid"), "radius", "o_radius")
    near = measured.join(radius, (F.col("pivot") == F.col("w_pivot")) & (F.col("sid") == F.col("w_sid")) & (F.col("distance") <= F.lit(r + TINY) + F.col("radius") + F.col("o_radius")))
    near = stage(_apart(near.select("pivot", "sid", "distance", "radius", "o_radius"), classes, "pivot", "sid"))
    sides = near.select(F.col("pivot").alias("own"), F.col("sid").alias("to"), "distance", F.col("o_radius").alias("radius"))
    sides = sides.unionByName(near.select(F.col("sid").alias("own"), F.col("pivot").alias("to"), "distance", "radius"))
    members = homes.filter("sid <> cell").select(F.col("sid").alias("x"), F.col("cell").alias("x_cell"), F.col("distance").alias("x_distance"))
    members, sides = _sketched(members, sets, "x", "a"), _sketched(sides, sets, "to", "b")
    window = F.col("distance") - F.col("x_distance") <= F.lit(r + TINY) + F.col("radius")
    boundary = members.join(sides, (F.col("x_cell") == F.col("own")) & window & _near("a", "b", F.lit(r) + F.col("radius")))
    boundary = stage(boundary.select("x", "own", "x_distance", "to", "radius"))
    if boundary.isEmpty():
        return classes
    reached = _measure(boundary.select(F.col("to").alias("pivot"), F.col("x").alias("sid")).distinct(), sets)
    links, classes = _with_links(links, reached, classes, percent)
    # What is left: two boundary sets of two cells.
    reached = reached.select(F.col("pivot").alias("t_pivot"), F.col("sid").alias("t_sid"), F.col("distance").alias("to_distance"))
    placed_at = boundary.join(reached, (F.col("to") == F.col("t_pivot")) & (F.col("x") == F.col("t_sid")) & (F.col("to_distance") <= F.lit(r + TINY) + F.col("radius")))
    placed_at = stage(_apart(placed_at.select("x", "own", "x_distance", "to", "to_distance"), classes, "own", "to"))
    ones = _sketched(placed_at.filter("own < to"), sets, "x", "a")
    twos = placed_at.filter("own > to").select(F.col("x").alias("y"), F.col("own").alias("y_own"), F.col("x_distance").alias("y_distance"), F.col("to").alias("y_to"), F.col("to_distance").alias("y_to_distance"))
    twos = _sketched(twos, sets, "y", "b")
    window = (F.abs(F.col("x_distance") - F.col("y_to_distance")) <= r + TINY) & (F.abs(F.col("to_distance") - F.col("y_distance")) <= r + TINY)
    last = ones.join(twos, (F.col("own") == F.col("y_to")) & (F.col("to") == F.col("y_own")) & window & _near("a", "b", F.lit(r)))
    last = stage(last.select(F.col("x").alias("pivot"), F.col("y").alias("sid")).distinct())
    return classes if last.isEmpty() else _with_links(links, _measure(last, sets), classes, percent)[1]


def join_documents(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id (the least doc_id that links reach), class_id (a
    number of the component, null for texts without words) and text_key.

    Sets are of 64-bit hashes of shingles and are identified by 64-bit digests. Texts without words have empty sets
    and are linked with nothing, whatever else is empty; equal sets are linked; rows of one doc_id count as one node
    only where their sets are linked. A null doc_id is never the least unless all of a component are null. An empty
    table has no rows. Columns besides doc_id and text are ignored.
    """
    shared_dir(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text").select("doc_id", "text_key", F.xxhash64("doc_id", "text_key").alias("row_key"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle).tobytes())
    profiles = stage(docs.mapInArrow(_profiles(shared, shingle, percent), "doc_id long, text_key long, row_key long, n long, sid long, regions array<long>"))
    rows = stage(profiles.select("doc_id", "text_key", "n", "sid"))
    total, keys = profiles.agg(F.count("*"), F.count_distinct("row_key")).first()
    classes = link_sets(profiles, docs, total != keys, shingle, percent).withColumnRenamed("node", "c_node")
    filled = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    filled = filled.join(classes, F.col("sid") == F.col("c_node"), "left").select("sid", "least", F.coalesce("component", "sid").alias("class"))
    least = filled.groupBy("class").agg(F.min("least").alias("component_id")).withColumnRenamed("class", "l_class")
    named = stage(filled.join(least, F.col("class") == F.col("l_class")).select(F.col("sid").alias("i_sid"), "component_id", F.col("class").alias("class_id")))
    joined = rows.join(named, (F.col("n") > 0) & (F.col("sid") == F.col("i_sid")), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id", "text_key")
