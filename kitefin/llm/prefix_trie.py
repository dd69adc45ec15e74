"""Prefix tries of conversations in level order (LOUDS), and what shared prefixes save.

A prefix of turns is a node, named by a 128-bit digest chained over its turns; nodes are counted by a grouping that is
combined before the shuffle, so a first turn that a third of all conversations share is a row a task. Behind the last
prefix that a conversation shares it is a chain whose sums are known; the trie holds the shared nodes and the first node
of each chain.

1. Turns are reduced to digests and lengths where they are read. Each conversation's rebuilt turns pass through one task
   in order, as a stream that only holds the digest of the turn at hand.
2. Shards. A node goes to the shard of its first ancestor, of those at the depths CUTS, that has SHARD_NODES nodes below
   it or fewer. Nodes without one are the heavy upper levels.
3. In a shard numpy puts nodes into level order and builds the bitvector (a 1 for each child, a 0 behind them) and the
   array of labels. Parents are found by rank and select on the bits, and sums go up level by level from the last.
4. Upper levels are merged separately, from the deepest up: what shards and lower levels have is summed by parent, by a
   grouping that is combined before the shuffle as well.
5. The ids that end at a node are sorted by range, so that a node may span many tasks, and are hashed as a stream of
   their chunks.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop, shared_dir, stage

#: conversation c takes turns from c - c % GROUP; up to MOST_HEAD - 1 of them.
GROUP, MOST_HEAD = 100, 6
#: Depths at which subtrees may be cut off, and the most nodes of one.
CUTS = (1, 2, 3, 4, 6, 8, 12, 16)
SHARD_NODES = 512
#: Of a subtree below the last cut.
DEEP_NODES = 1_000_000
#: Nodes that one step of numpy works on, but for a single larger shard.
BATCH_NODES = 200_000
#: Ids in a row on their way to the hash of a node's ends.
CHUNK_IDS = 8192
NO_IDS = hashlib.sha256(b"").hexdigest()
_ROOT = hashlib.blake2b(b"", digest_size=16).digest()


class Louds:
    """A forest in level order. bits: for a root above all, then for each node, a 1 a child and a 0."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        self._ones = np.flatnonzero(bits)  # select of ones: node k is the k-th one
        self._zeros = np.flatnonzero(bits == 0)

    @classmethod
    def build(cls, name: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[Louds, np.ndarray]:
        """The trie of nodes, whose parent is a node among them or not, and the level order of the rows."""
        order, before = [], np.zeros(0, name.dtype)
        degrees = []
        for level in np.unique(depth):
            rows = np.flatnonzero(depth == level)
            if len(before) and level == last + 1:
                by = np.argsort(before)
                at = np.minimum(np.searchsorted(before[by], parent[rows]), len(by) - 1)
                found = before[by][at] == parent[rows]
                place = np.where(found, by[at], -1)
            else:
                place = np.full(len(rows), -1)
            if (place < 0).any() and len(order):
                raise ValueError("a shard's roots are of one depth")
            rows = rows[np.lexsort((name[rows], place))]
            degrees.append(np.bincount(np.sort(place), minlength=len(before)) if len(order) else np.array([len(rows)]))
            order.append(rows)
            before, last = name[rows], level
        degrees.append(np.zeros(len(before), np.int64))
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        degree = np.concatenate(degrees)
        bits = np.ones(int(degree.sum()) + len(degree), np.uint8)
        bits[np.cumsum(degree + 1) - 1] = 0
        return cls(bits, name[order]), order

    def parents(self) -> np.ndarray:
        """Of each node, -1 for roots: the zeros before its one are the nodes that are finished, the root above first."""
        return self._ones - np.arange(len(self._ones)) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(self._zeros) - 1

    def children(self, node: int) -> range:
        """Of a node, or of the root above all for -1: from the ones between two zeros."""
        start = 0 if node < 0 else int(self._zeros[node]) + 1
        end = int(self._zeros[node + 1])
        first = start - (node + 1)
        return range(first, first + end - start)

    def find(self, node: int, label) -> int | None:
        """The child of a node that has a label; labels of children are in order."""
        at = self.children(node)
        k = at.start + int(np.searchsorted(self.labels[at.start : at.stop], label))
        return k if k < at.stop and self.labels[k] == label else None

    def rollup(self, own: np.ndarray, leaf: bool = False) -> np.ndarray:
        """Sums over subtrees, from the last level to the first; with `leaf`, own counts only for nodes without children."""
        parent, total = self.parents(), np.where(self.degrees() == 0, own, 0) if leaf else own.copy()
        # Levels: a level ends where the first child of its first node begins.
        edge, ends = [0], int(np.count_nonzero(parent < 0))
        while ends < len(parent):
            edge.append(ends)
            ends = int(np.searchsorted(parent, ends, "left"))
        for a, b in reversed(list(zip(edge[1:], [*edge[2:], len(parent)]))):
            np.add.at(total, parent[a:b], total[a:b])
        return total


def _digest(*columns: str) -> Column:
    """16 bytes of texts, each after its length, so that no two lists of texts are written alike."""
    said = [x for c in columns for x in (F.length(c).cast("string"), F.lit(":"), F.col(c))]
    return F.unhex(F.md5(F.concat(*said).cast("binary")))


def labelled(conversations: DataFrame) -> DataFrame:
    """conv, position, label, chars of each turn, in the order of (turn, role, text), a null turn first."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).filter("conv is not null")
    turns = stage(rows.select("conv", "turn", _digest("role", "text").alias("label"), F.length("text").cast("long").alias("chars")))
    # Only of turns with one number the texts are compared.
    tied = stage(turns.groupBy("conv", "turn").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select(F.col("conv").alias("t_conv"), F.col("turn").alias("t_turn")))
    same = (F.col("conv") == F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn"))
    if tied.isEmpty():
        ranked = turns.withColumn("rank", F.lit(0))
    else:
        among = Window.partitionBy("conv", "turn").orderBy("role", "text")
        ranks = rows.join(tied, same, "left_semi").distinct().select(F.col("conv").alias("t_conv"), F.col("turn").alias("t_turn"), _digest("role", "text").alias("t_label"), F.row_number().over(among).alias("t_rank"))
        ranked = turns.join(ranks, same & (F.col("label") == F.col("t_label")), "left").select(*turns.columns, F.coalesce("t_rank", F.lit(0)).alias("rank"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "rank")
    placed = stage(ranked.select("conv", (F.row_number().over(order) - 1).cast("long").alias("position"), "label", "chars"))
    drop(turns, tied)
    return placed


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv, position, label, chars of rebuilt conversations; and a row at position -1 for each conversation."""
    take = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(MOST_HEAD))
    convs = placed.filter("position = 0").select("conv", take.alias("take"), (F.col("conv") - F.col("conv") % GROUP).alias("from"))
    heads = placed.filter((F.col("conv") % GROUP == 0) & (F.col("position") < MOST_HEAD - 1)).select(F.col("conv").alias("h_conv"), "position", "label", "chars")
    borrowed = convs.join(heads, (F.col("from") == F.col("h_conv")) & (F.col("position") < F.col("take"))).select(*placed.columns)
    own = placed.filter(F.col("position") >= take)
    start = convs.select("conv", F.lit(-1).cast("long").alias("position"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(borrowed).unionByName(start)


_CUT = [f"cut_{c}" for c in CUTS]
_VISIT = "conv long, hi long, lo long, p_hi long, p_lo long, depth int, chars long, ends int, " + ", ".join(f"{c} long" for c in _CUT)


def _visits(batches):
    """Each prefix that a conversation passes. A prefix is known to be the last when another conversation begins."""
    names = [x.split()[0] for x in _VISIT.split(", ")]
    held: list[list] = [[] for _ in names]
    row, node, path = None, _ROOT, []

    def out():
        nonlocal held
        columns = [pa.array(c, pa.int32() if n in ("depth", "ends") else pa.int64()) for n, c in zip(names, held)]
        held = [[] for _ in names]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def put(ends: int):
        for c, x in zip(held, (*row[:7], ends, *path, *[None] * (len(CUTS) - len(path)))):
            c.append(x)

    signed = lambda b: int.from_bytes(b, "little", signed=True)
    for batch in batches:
        for conv, position, label, chars in zip(*(batch.column(c).to_pylist() for c in ("conv", "position", "label", "chars"))):
            if row is not None:
                put(int(position < 0))
            if position < 0:
                node, path = _ROOT, []
                row = (conv, signed(node[:8]), signed(node[8:]), None, None, 0, 0)
                continue
            after = hashlib.blake2b(node + label, digest_size=16).digest()
            depth = row[5] + 1
            row = (conv, signed(after[:8]), signed(after[8:]), signed(node[:8]), signed(node[8:]), depth, chars)
            node = after
            if depth in CUTS:
                path = [*path, row[1]]
        if len(held[0]) >= 20_000:
            yield out()
    if row is not None:
        put(1)
    if held[0]:
        yield out()


_ROLLED = "hi long, lo long, p_hi long, p_lo long, depth int, is_root boolean, n_children long, n_leaves long, saved long"


def _names(batch: dict, prefix: str) -> np.ndarray:
    """Both halves as one sortable value."""
    out = np.zeros(len(batch["hi"]), [("hi", "i8"), ("lo", "i8")])
    out["hi"], out["lo"] = batch[f"{prefix}hi"], batch[f"{prefix}lo"]
    return out


def _rank(names: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and parents as numbers in the order of names."""
    every, number = np.unique(np.concatenate([names, parents]), return_inverse=True)
    return number[: len(names)], number[len(names) :]


def _whole_shards(batches, columns: tuple[str, ...]):
    """Arrays of whole shards, of BATCH_NODES nodes or so; rows of a shard come together."""
    held: list[dict] = []
    for batch in batches:
        held.append({c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in columns})
        if sum(len(h["hi"]) for h in held) >= BATCH_NODES:
            joined = {c: np.concatenate([h[c] for h in held]) for c in columns}
            new = np.flatnonzero((np.diff(joined["cut"]) != 0) | (np.diff(joined["shard"]) != 0))
            if len(new):
                k = int(new[-1]) + 1
                yield {c: v[:k] for c, v in joined.items()}
                joined = {c: v[k:] for c, v in joined.items()}
            held = [joined]
    if held and sum(len(h["hi"]) for h in held):
        yield {c: np.concatenate([h[c] for h in held]) for c in columns}


def _by_cut(part: dict):
    """Shards cut at one depth form one forest."""
    for cut in np.unique(part["cut"]):
        rows = np.flatnonzero(part["cut"] == cut)
        yield cut, {c: v[rows] for c, v in part.items()}


def _roll(batches):
    for part in _whole_shards(batches, ("hi", "lo", "p_hi", "p_lo", "depth", "saved", "cut", "shard")):
        for cut, own in _by_cut(part):
            trie, order = Louds.build(*_rank(_names(own, ""), _names(own, "p_")), own["depth"])
            own = {c: v[order] for c, v in own.items()}
            rolled = (trie.degrees(), trie.rollup(np.ones(len(order), np.int64), leaf=True), trie.rollup(own["saved"]))
            columns = [pa.array(own[c]) for c in ("hi", "lo", "p_hi", "p_lo")] + [pa.array(own["depth"].astype(np.int32)), pa.array(own["depth"] == cut)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.astype(np.int64)) for x in rolled)], names=[x.split()[0] for x in _ROLLED.split(", ")])


def _tries(batches):
    for part in _whole_shards(batches, ("hi", "lo", "p_hi", "p_lo", "depth", "n_convs", "cut", "shard")):
        edge = np.flatnonzero(np.r_[True, (np.diff(part["cut"]) != 0) | (np.diff(part["shard"]) != 0), True])
        rows = []
        for a, b in zip(edge[:-1], edge[1:]):
            own = {c: v[a:b] for c, v in part.items()}
            name, parent = _names(own, ""), _names(own, "p_")
            trie, order = Louds.build(*_rank(name, parent), own["depth"])
            rows.append((int(own["cut"][0]), int(own["shard"][0]), b - a, len(trie.bits), np.packbits(trie.bits).tobytes(), name[order].tobytes(), own["n_convs"][order].tolist()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["cut", "shard", "n_nodes", "n_bits", "bits", "labels", "n_convs"])


def _shards(trie: DataFrame, shard_nodes: int, deep_nodes: int) -> tuple[DataFrame, DataFrame | None]:
    """trie's rows with cut and shard; and the rows of the upper levels, staged."""
    light, upper, todo = [], [], trie
    for k, (cut, column) in enumerate(zip(CUTS, _CUT)):
        upper.append(todo.filter(F.col("depth") < cut))
        todo = todo.filter(F.col("depth") >= cut)
        most = shard_nodes if k + 1 < len(CUTS) else max(shard_nodes, deep_nodes)
        # Staged, so that Spark can split a prefix that a third of all rows have.
        heavy = stage(todo.groupBy(F.col(column).alias("heavy")).count().filter(F.col("count") > most).select("heavy"))
        own = todo.withColumns({"cut": F.lit(cut), "shard": F.col(column)})
        if heavy.isEmpty():
            light.append(own)
            break
        light.append(own.join(heavy, F.col("shard") == F.col("heavy"), "left_anti"))
        todo = stage(todo.join(heavy, F.col(column) == F.col("heavy"), "left_semi"))
    else:
        upper.append(todo)
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(light), stage(union(upper))


def _ends(visits: DataFrame) -> DataFrame:
    """e_hi, e_lo, ends_sha256 of nodes where conversations end."""

    def chunks(batches):
        node, first, ids, rows = None, None, [], []
        for batch in batches:
            for hi, lo, conv in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "conv"))):
                if node != (hi, lo) or len(ids) >= CHUNK_IDS:
                    if ids:
                        rows.append((*node, first, ",".join(map(str, ids))))
                    node, first, ids = (hi, lo), conv, []
                ids.append(conv)
            if len(rows) >= 10_000:
                yield _rows(rows, ("hi", "lo", "first", "ids"))
                rows = []
        if ids:
            rows.append((*node, first, ",".join(map(str, ids))))
        if rows:
            yield _rows(rows, ("hi", "lo", "first", "ids"))

    def hashed(batches):
        node, digest, rows = None, None, []
        for batch in batches:
            for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids"))):
                if node != (hi, lo):
                    if node is not None:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = (hi, lo), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if len(rows) >= 10_000:
                yield _rows(rows, ("e_hi", "e_lo", "ends_sha256"))
                rows = []
        if node is not None:
            rows.append((*node, digest.hexdigest()))
            yield _rows(rows, ("e_hi", "e_lo", "ends_sha256"))

    ending = visits.filter("ends = 1").select("hi", "lo", "conv").repartitionByRange("hi", "lo", "conv").sortWithinPartitions("hi", "lo", "conv")
    spans = ending.mapInArrow(chunks, "hi long, lo long, first long, ids string")
    return spans.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(hashed, "e_hi long, e_lo long, ends_sha256 string")


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)], names=list(names))


def _nodes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: one row a prefix, and one row for each prefix that a conversation passes."""
    shared_dir(conversations.sparkSession)
    placed = labelled(conversations)
    turns = rebuilt(placed).repartition("conv").sortWithinPartitions("conv", "position")
    visits = stage(turns.mapInArrow(_visits, _VISIT))
    drop(placed)
    same = ("p_hi", "p_lo", "chars", *_CUT)
    counted = visits.groupBy("hi", "lo", "depth").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("ends").alias("n_ends"), *(F.min(c).alias(c) for c in same))
    return stage(counted), visits


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id and in_trie: of shared nodes and of those whose parent is shared, or is the root."""
    shared = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    parents = nodes.filter(shared).select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.col("conv_id").alias("shared_parent"))
    held = nodes.join(parents, (F.col("p_hi") == F.col("q_hi")) & (F.col("p_lo") == F.col("q_lo")), "left")
    # Behind the last shared prefix all nodes have the one conversation.
    parent = F.when(F.col("depth") > 0, F.coalesce("shared_parent", "conv_id"))
    return held.select(*nodes.columns, parent.alias("parent_conv_id"), (shared | F.col("q_hi").isNotNull()).alias("in_trie"))


def prefixes(conversations: DataFrame, shard_nodes: int = SHARD_NODES, deep_nodes: int = DEEP_NODES) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, hi, lo.

    Rebuilt conversations: the first h turns of conversation c - c % 100, h = crc32(c) % 6, then c's own turns behind its
    first h. Null roles and texts are empty; turns are in the order of turn (null first), role, text; repeated rows are
    turns of their own. Rows without a conv_id belong to no conversation and are left out. An empty table has no nodes.
    Turns and prefixes are identified by 128-bit digests. Other columns are ignored.
    """
    nodes, visits = _nodes(conversations)
    known = stage(_with_parents(nodes))
    drop(nodes)
    own = (F.col("n_convs") - 1) * F.col("chars")
    trie = known.filter("in_trie").select("hi", "lo", "p_hi", "p_lo", "depth", own.alias("saved"), *_CUT)
    light, upper = _shards(trie, shard_nodes, deep_nodes)
    whole = ("hi", "lo", "p_hi", "p_lo", "depth", "saved", "cut", "shard")
    filled = light.select(*whole).repartition("cut", "shard").sortWithinPartitions("cut", "shard")
    rolled = stage(filled.mapInArrow(_roll, _ROLLED))
    done = [rolled.select("hi", "lo", "n_children", "n_leaves", "saved")]
    below = rolled.filter("is_root").select("p_hi", "p_lo", "depth", "n_leaves", "saved")
    deepest = upper.agg(F.max("depth")).first()[0]
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        under = below.filter(F.col("depth") == depth + 1).groupBy(F.col("p_hi").alias("b_hi"), F.col("p_lo").alias("b_lo")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
        level = upper.filter(F.col("depth") == depth).join(under, (F.col("hi") == F.col("b_hi")) & (F.col("lo") == F.col("b_lo")), "left")
        level = stage(level.select("hi", "lo", "p_hi", "p_lo", "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("b_leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + F.coalesce("b_saved", F.lit(0))).alias("saved")))
        done.append(level.select("hi", "lo", "n_children", "n_leaves", "saved"))
        below = rolled.filter("is_root").select("p_hi", "p_lo", "depth", "n_leaves", "saved").unionByName(level.select("p_hi", "p_lo", "depth", "n_leaves", "saved"))
    sums = functools.reduce(DataFrame.unionByName, done).select(F.col("hi").alias("r_hi"), F.col("lo").alias("r_lo"), "n_children", "n_leaves", "saved")
    held = known.join(sums, (F.col("hi") == F.col("r_hi")) & (F.col("lo") == F.col("r_lo")), "left")
    held = held.join(stage(_ends(visits)), (F.col("hi") == F.col("e_hi")) & (F.col("lo") == F.col("e_lo")), "left")
    # A chain that one conversation has alone.
    alone = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    return held.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
        F.when(alone, 1 - F.col("n_ends")).otherwise(F.col("n_children")).alias("n_children"),
        F.when(alone, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        F.when(alone, 0).otherwise(F.col("saved")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"), "hi", "lo",
    )


def tries(conversations: DataFrame, shard_nodes: int = SHARD_NODES, deep_nodes: int = DEEP_NODES) -> DataFrame:
    """The succinct tries, one row a shard: cut (its roots' depth), shard, n_nodes, n_bits, bits (packed), labels (16 bytes a
    node, in level order), n_convs (of each node). Nodes of the upper levels are in none; `prefixes` has their sums."""
    nodes, visits = _nodes(conversations)
    known = _with_parents(nodes).filter("in_trie").select("hi", "lo", "p_hi", "p_lo", "depth", "n_convs", *_CUT)
    light, _ = _shards(stage(known), shard_nodes, deep_nodes)
    drop(visits)
    whole = light.select("hi", "lo", "p_hi", "p_lo", "depth", "n_convs", "cut", "shard")
    return whole.repartition("cut", "shard").sortWithinPartitions("cut", "shard").mapInArrow(_tries, "cut int, shard long, n_nodes long, n_bits long, bits binary, labels binary, n_convs array<long>")
