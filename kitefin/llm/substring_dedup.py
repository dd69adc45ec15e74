"""Exact substring dedup with suffix arrays.

A byte is removed when a string of LENGTH bytes covers it that also starts earlier: in a smaller document or further
up in the same one. Strings are sampled into anchors first, so that the corpus never has to be sorted as one: of the
GRAM-grams inside a string the one with the least hash is its anchor, so equal strings have equal anchors at equal
offsets, and the strings of a document with one anchor are a run of neighbouring starts, a segment of text.

1. Anchors that occur once can't belong to repeated strings; they are dropped by a count.
2. Occurrences with equal segments repeat all strings of the segment; all but the first are marked, by a join.
3. Of anchors with different segments the first of each kind is kept. The segments of one anchor are concatenated and
   their suffixes sorted (`suffix_array`); neighbours that share LENGTH bytes are equal strings, and all but the first
   are marked. Anchors with more than GROUP_SEGMENTS kinds are split first: strings that start at similar distances
   from the anchor share a middle part, so its bytes and the range of distances make smaller groups, of which equal
   pieces are marked as in step 2; ranges are cut in four until no group is too large, at the latest at single strings.
4. Marks are joined to the documents, and what they cover is cut out.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir, stage, text_groups
from .suffix_array import suffix_arrays

LENGTH, GRAM = 100, 16
GROUP_SEGMENTS = 48
#: Symbols that one batch of suffix arrays holds, but for a single larger group.
BATCH_SYMBOLS = 1_500_000
#: Anchors of longer texts are taken from overlapping pieces.
PIECE = 1 << 22

_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = {k: np.uint64(k) for k in (24, 29, 31, 32)}
#: shape: the anchor's distance from the segment's start, and the number of strings.
_PLACE = "anchor long, segment long, doc long, tie long, start int, shape int"
_PIECE = "anchor long, segment long, doc long, tie long, start int, distance int, data binary"
_SHAPE = 1 << 15


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last string start, and the anchor's place of each segment, in order."""
    found = [_anchors(data[k : k + PIECE + length - 1], length, k) for k in range(0, max(1, len(data) - length + 1), PIECE)]
    return tuple(map(np.concatenate, zip(*found)))


def _anchors(data: bytes, length: int, shift: int) -> tuple[np.ndarray, ...]:
    if len(data) < length:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    later = words[GRAM - 8 :]
    h = words[: len(later)] * _M[0] + (later ^ (later >> _S[31])) * _M[1]
    h ^= h >> _S[32]
    h *= _M[2]
    h ^= h >> _S[29]
    # The place in the low bits makes the leftmost of equals the least.
    least = (h >> _S[24] << _S[24]) | np.arange(len(h), dtype=np.uint64)
    width, held, n = length - GRAM + 1, 1, len(data) - length + 1
    while held * 2 <= width:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    least = np.minimum(least[:n], least[width - held :][:n])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]], first + shift, np.r_[first[1:], n] - 1 + shift, at[first] + shift


def _emit(length: int, only_anchor: bool):
    """Rows of all segments, or just their anchors."""

    def run(batches):
        names = ["anchor"] if only_anchor else ["anchor", "segment", "doc", "tie", "start", "shape"]
        for batch, texts in text_groups(batches):
            rows, many = [], []
            for text in texts:
                data = (text or "").encode("utf-8", "surrogatepass")
                h, a, b, at = anchors(data, length)
                many.append(len(h))
                if only_anchor:
                    rows.append((h.view(np.int64),))
                elif len(h):
                    ends = (b + length).tolist()
                    seg = np.array([xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(a.tolist(), ends)], np.uint64)
                    rows.append((h.view(np.int64), seg.view(np.int64), a.astype(np.int32), ((at - a) * _SHAPE + b - a + 1).astype(np.int32)))
            if not sum(many):
                continue
            columns = [pa.array(np.concatenate(c)) for c in zip(*rows)]
            if not only_anchor:
                take = pa.array(np.repeat(np.arange(len(texts)), many))
                columns[2:2] = [batch.column("doc").take(take), batch.column("tie").take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _solve(length: int):
    """Marks from the groups of one anchor: rows of a group are together, ordered by its size."""

    def run(batches):
        held: list[tuple] = []
        symbols = 0
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "tie", "start", "data"))):
                if group and group[0][0] != row[0]:
                    held.append(group)
                    symbols += sum(len(r[4]) + 1 for r in group)
                    group = []
                    if symbols >= BATCH_SYMBOLS:
                        yield _marks(held, length)
                        held, symbols = [], 0
                group.append(row)
        if group:
            held.append(group)
        if held:
            yield _marks(held, length)

    return run


def _marks(groups: list[list[tuple]], length: int) -> pa.RecordBatch:
    """Runs of strings of the groups' segments that also start earlier, as byte ranges."""
    rows = [r for g in groups for r in g]
    size = np.array([len(r[4]) for r in rows], np.int64)
    # Bytes are 2 to 257, a 1 stands between segments, a 0 ends the group.
    symbols = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", np.uint8).astype(np.int16) + 2
    after = np.cumsum(size + 1)
    at = after - size - 1  # of each segment's first byte
    symbols[after - 1] = 1
    last = np.cumsum([len(g) for g in groups])
    symbols[after[last - 1] - 1] = 0
    base = np.r_[0, after[last - 1]]
    order = suffix_arrays(symbols, base)
    # Only suffixes that start a whole string count; equal strings are neighbours among them.
    whole = np.zeros(len(symbols), bool)
    owner = np.repeat(np.arange(len(rows)), size + 1)
    whole[np.arange(len(symbols)) - at[owner] <= size[owner] - length] = True
    order = order[whole[order]]
    strings = np.lib.stride_tricks.sliding_window_view(symbols, length)
    same = np.zeros(len(order), bool)
    for k in range(0, len(order) - 1, 20_000):
        a, b = order[k : k + 20_000], order[k + 1 : k + 20_001]
        same[k + 1 : k + 1 + len(b)] = (strings[a[: len(b)]] == strings[b]).all(axis=1)
    kind = np.cumsum(~same)
    # The order of rows by document, then of starts; ties of both are one place.
    start = np.array([r[3] for r in rows], np.int64)
    places = sorted({(r[1] is not None, r[1] or 0, r[2]) for r in rows})
    number = {p: k for k, p in enumerate(places)}
    doc = np.array([number[(r[1] is not None, r[1] or 0, r[2])] for r in rows], np.int64)
    own = owner[order]
    where = start[own] + order - at[own]
    by = np.lexsort((where, doc[own], kind))
    k, d, w = kind[by], doc[own][by], where[by]
    first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(k) else np.zeros(0, np.int64)
    marked = by[(d != d[lead]) | (w != w[lead])]
    spot = np.sort(order[marked])
    cut = np.flatnonzero(np.r_[True, np.diff(spot) != 1]) if len(spot) else np.zeros(0, np.int64)
    end = np.r_[cut[1:], len(spot)] - 1 if len(spot) else cut
    lo, hi = spot[cut], spot[end]
    own = owner[lo]
    low = start[own] + lo - at[own]
    return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in own], pa.int64()), pa.array([rows[k][2] for k in own], pa.int64()), pa.array(low, pa.int32()), pa.array(low + hi - lo + length, pa.int32())], names=["doc", "tie", "low", "high"])


def marks(documents: DataFrame, length: int = LENGTH, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """doc, tie, low, high: byte ranges to remove, any number of them over each other. documents: doc, tie, text."""
    counted = documents.select("text").mapInArrow(_emit(length, True), "anchor long").groupBy("anchor").count()
    # Staged, so that the join deals both sides anew and Spark can split an anchor that is everywhere.
    repeated = stage(counted.filter("count > 1").select(F.col("anchor").alias("r_anchor")))
    every = documents.mapInArrow(_emit(length, False), _PLACE)
    every = stage(every.join(repeated, F.col("anchor") == F.col("r_anchor"), "left_semi"))
    place = F.struct("doc", "tie", "start")
    kinds = stage(every.groupBy("anchor", "segment").agg(F.min(place).alias("first"), F.first("shape").alias("shape"), F.count("*").alias("n")))
    found = _later(every, kinds, F.col("shape") % _SHAPE, length)
    many = stage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select(F.col("anchor").alias("m_anchor"), "kinds"))
    differing = kinds.join(many, F.col("anchor") == F.col("m_anchor")).select("anchor", "kinds", "first.doc", "first.tie", "first.start", "shape")
    # The bytes of these segments, from a list of them for each document.
    wanted = differing.groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "kinds", "start", "shape")).alias("wanted"))
    wanted = wanted.select(F.col("doc").alias("w_doc"), F.col("tie").alias("w_tie"), "wanted")
    cut = documents.join(wanted, F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("tie") == F.col("w_tie"))).select("doc", "tie", "text", "wanted")
    cut = stage(cut.mapInArrow(_cut(length), "anchor long, kinds long, doc long, tie long, start int, distance int, data binary"))
    width = 1 << (length - GRAM).bit_length()  # of the ranges of distances, that of all at first
    small, split = [], []
    while True:
        small.append(cut.filter(F.col("kinds") <= group_segments).select("anchor", "kinds", "doc", "tie", "start", "data"))
        crowded = cut.filter(F.col("kinds") > group_segments).drop("kinds")
        if crowded.isEmpty():
            break
        width = max(1, width // 4)
        pieces = stage(crowded.mapInArrow(_split(length, width), _PIECE))
        kinds = stage(pieces.groupBy("anchor", "segment").agg(F.min(F.struct("doc", "tie", "start", "distance", "data")).alias("first"), F.count("*").alias("n")))
        split.append((pieces, kinds))
        many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select(F.col("anchor").alias("m_anchor"), "kinds")
        cut = stage(kinds.join(many, F.col("anchor") == F.col("m_anchor")).select("anchor", "kinds", "first.*"))
    if split:  # names of groups hold the width, so that all rounds can be joined at once
        pieces, kinds = (functools.reduce(DataFrame.unionByName, x) for x in zip(*split))
        kinds = kinds.select("anchor", "segment", "n", F.struct("first.doc", "first.tie", "first.start").alias("first"))
        found = found.unionByName(_later(pieces, kinds, F.octet_length("data") - (length - 1), length))
    groups = functools.reduce(DataFrame.unionByName, small).repartition("anchor").sortWithinPartitions("kinds", "anchor")
    solved = groups.select("anchor", "doc", "tie", "start", "data").mapInArrow(_solve(length), "doc long, tie long, low int, high int")
    return found.unionByName(solved)


def _later(every: DataFrame, kinds: DataFrame, strings: Column, length: int) -> DataFrame:
    """Marks of all strings of the segments that aren't the first of their kind."""
    copied = kinds.filter("n > 1").select(F.col("anchor").alias("k_anchor"), F.col("segment").alias("k_segment"), "first")
    later = every.join(copied, (F.col("anchor") == F.col("k_anchor")) & (F.col("segment") == F.col("k_segment"))).filter(~F.struct("doc", "tie", "start").eqNullSafe(F.col("first")))
    return later.select("doc", "tie", F.col("start").alias("low"), (F.col("start") + strings - 1 + length).cast("int").alias("high"))


def _cut(length: int):
    def run(batches):
        for batch, texts in text_groups(batches):
            out: list[tuple] = []
            docs, ties, wanted = (batch.column(c).to_pylist() for c in ("doc", "tie", "wanted"))
            for text, doc, tie, want in zip(texts, docs, ties, wanted):
                data = (text or "").encode("utf-8", "surrogatepass")
                out += [(w["anchor"], w["kinds"], doc, tie, w["start"], w["shape"] // _SHAPE, data[w["start"] : w["start"] + w["shape"] % _SHAPE - 1 + length]) for w in want]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["anchor", "kinds", "doc", "tie", "start", "distance", "data"])

    return run


def _split(length: int, width: int):
    """Pieces of segments for ranges of `width` distances between the anchor and a string's start.

    All strings of a range hold the bytes from the latest of its starts to the earliest of its ends; together with the
    old group and the range they name the new group.
    """

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for k in range(0, batch.num_rows, 10_000):
                out: list[tuple] = []
                part = batch.slice(k, 10_000)
                for anchor, doc, tie, start, distance, data in zip(*(part.column(c).to_pylist() for c in ("anchor", "doc", "tie", "start", "distance", "data"))):
                    least = distance - (len(data) - length)  # of the distances of the segment's strings
                    for low in range(least // width * width, distance + 1, width):
                        far, near = min(distance, low + width - 1), max(least, low)
                        shared = data[distance - low : distance - low - width + 1 + length]
                        piece = data[distance - far : distance - near + length]
                        name = xxhash.xxh3_64_intdigest(b"%d %d %d " % (anchor, width, low) + shared)
                        out.append((_signed(name), _signed(xxhash.xxh3_64_intdigest(piece)), doc, tie, start + distance - far, far, piece))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["anchor", "segment", "doc", "tie", "start", "distance", "data"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apply(batches):
    for batch, texts in text_groups(batches):
        out = []
        ranges = batch.column("ranges")
        offsets = ranges.offsets.to_numpy()
        held = ranges.values
        lows, highs = (held.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        for k, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            low, high = lows[offsets[k] : offsets[k + 1]], highs[offsets[k] : offsets[k + 1]]
            if not len(low):
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            order = np.argsort(low)
            low, high = low[order], np.maximum.accumulate(high[order])
            # A run of removed bytes starts where a range starts beyond all that came before it.
            first = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
            begin, end = low[first].tolist(), high[np.r_[first[1:], len(low)] - 1].tolist()
            kept, done = hashlib.sha256(), 0
            for a, b in zip(begin, end):
                kept.update(data[done:a])
                done = b
            kept.update(data[done:])
            out.append((len(data), sum(end) - sum(begin), len(begin), kept.hexdigest()))
        columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_substrings(documents: DataFrame, length: int = LENGTH, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """One row for each row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; texts shorter than `length` bytes stay whole; a null doc_id comes before all others. Rows of
    one doc_id with different texts are documents of their own, in the order of a hash of their texts; equal rows are
    one document, and give equal rows. An empty table gives an empty result. Other columns are ignored.
    """
    shared_dir(documents.sparkSession)
    if length < GRAM:
        raise ValueError(f"strings have {GRAM} bytes at least")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows, distinct = ids.agg(F.count("*"), F.count_distinct("doc_id")).first()
    tie = F.lit(0).cast("long") if rows == distinct else F.xxhash64(F.coalesce("text", F.lit("")))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), tie.alias("tie"), "text")
    ranges = stage(marks(docs if rows == distinct else docs.dropDuplicates(["doc", "tie"]), length, group_segments).groupBy("doc", "tie").agg(F.collect_list(F.struct("low", "high")).alias("ranges")))
    ranges = ranges.select(F.col("doc").alias("m_doc"), F.col("tie").alias("m_tie"), "ranges")
    joined = docs.join(ranges, F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("tie") == F.col("m_tie")), "left")
    return joined.select(F.col("doc").alias("doc_id"), "text", "ranges").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
