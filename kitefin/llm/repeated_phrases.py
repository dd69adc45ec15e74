"""Repeated-phrase automata: passages that recur in several documents, located by Aho-Corasick over words.

A window is WINDOW consecutive words. It recurs if it starts in two documents of different ids, and its home is the
smallest of those ids; a word is removed where a recurring window of another home covers it.

1. Packs. Texts are put together to rows of PACK_BYTES or so, so that what is known of a text's windows can be sent as
   arrays of numbers instead of a row each.
2. Which windows recur. Each pack sends its windows' keys (the shard and 32 bits in it) with the smallest document to the
   shards; a shard's keys are sorted and those of two documents go back to their packs with their home. Keys are only
   candidates: a key that two windows share costs a look and no more.
3. Passages. Runs of windows with one home are cut out of the texts: in the home itself they are the phrases to look for,
   elsewhere the places to look at.
4. Automata, sharded by home. A task builds automata of its homes' passages, a character for each word that they hold,
   and streams all places through them; windows that they find are removed. Homes that are copied very often are
   dealt over many tasks, and their phrases with them.
5. A window that its home's automaton doesn't hold had the key of another; these few are compared by their words.
6. Texts and found ranges meet by pack, and what is left of each text is put together.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, shared_dir, stage, text_groups

WINDOW = 13
PACK_BYTES = 1_000_000
#: Of text whose windows one shard of keys holds; shards grow in number with the input.
SHARD_BYTES = 8_000_000
#: Of phrases in the automata of one task; tasks grow in number with the input.
PHRASE_BYTES = 1_000_000
#: Of places for one home that one task looks at, unless the home's own phrases are a quarter of that or more.
PLACE_BYTES = 48_000
#: Different words in one automaton: code points below the surrogates and above them.
MOST_WORDS = 1_000_000
#: Hashes of words that a worker remembers.
KNOWN_WORDS = 400_000
#: In the order of ids a null id comes first.
NO_ID = -(1 << 63)

_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_S = {k: np.uint64(k) for k in (27, 30, 31, 32)}


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Windows:
    """Of the texts of a pack: words, where documents end, and the key of each window."""

    def __init__(self, window: int, bits: int, key_bits: int = 32):
        self.window, self.shift, self.known = window, np.uint64(32 - bits), _Words()
        self.used = np.uint64(((1 << bits) - 1) << 32 | (1 << key_bits) - 1)

    def __call__(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts, the end of each text among them, and of each window its start, text and key."""
        if len(self.known) > KNOWN_WORDS:
            self.known = _Words()
        split = [t.split() if t else [] for t in texts]
        words = [w for s in split for w in s]
        ends = np.cumsum([len(s) for s in split])
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = max(0, len(h) - self.window + 1)
        out = np.full(n, self.window, np.uint64)
        for k in range(self.window):
            out = (out ^ (out >> _S[31])) * _M[k % 4] + h[k : n + k]
        out = (out ^ (out >> _S[30])) * _M[1]
        out = (out ^ (out >> _S[27])) * _M[2]
        out ^= out >> _S[31]
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[:n]
        starts = np.flatnonzero(np.arange(n) + self.window <= ends[owner]) if n else np.zeros(0, np.int64)
        return words, ends, starts, owner[starts], (out[starts] >> self.shift) & self.used


def _pack(batches):
    """One row for each group of texts: pack, ids, texts, n_bytes."""
    part, count = TaskContext.get().partitionId(), 0
    for group, _ in text_groups(batches, chars=PACK_BYTES):
        texts = group.column("text")
        held = [pa.ListArray.from_arrays(pa.array([0, group.num_rows], pa.int32()), c) for c in (group.column("doc_id"), texts.cast(pa.binary()))]
        size = pc.sum(pc.binary_length(texts)).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), *held, pa.array([size], pa.int64())], names=["pack", "ids", "texts", "n_bytes"])
        count += 1


def _numbers(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Ids of a pack's documents, a null one as the least."""
    return batch.column("ids")[k].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


_KEYS = "shard int, pack long, low binary, docs binary, base long, width int, several binary"


def _keys(window: int, bits: int, key_bits: int):
    """Of each pack and shard: different keys in order, the smallest document of each, and which have several."""

    def run(batches):
        windows = Windows(window, bits, key_bits)
        for batch in batches:
            for k, (pack, texts) in enumerate(zip(batch.column("pack").to_pylist(), batch.column("texts").to_pylist())):
                _, _, _, owner, keys = windows(texts)
                if not len(keys):
                    continue
                docs = _numbers(batch, k)[owner]
                order = np.argsort(keys)
                keys, docs = keys[order], docs[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, low, high = keys[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
                base, span = int(low.min()), int(low.max()) - int(low.min())
                width = next((w for w in (2, 4) if span < 1 << (8 * w)), 8)
                base = base if width < 8 else 0
                shard = (keys >> _S[32]).astype(np.int64)
                bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
                several = [np.flatnonzero(low[a:b] != high[a:b]).astype(np.uint32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                n = len(several)
                columns = [shard[bounds[:-1]].astype(np.int32), np.full(n, pack), np.full(n, base), np.full(n, width, np.int32)]
                shard_, pack_, base_, width_ = map(pa.array, columns)
                docs_ = _binaries((low - base).astype({2: np.uint16, 4: np.uint32, 8: np.int64}[width]), bounds)
                yield pa.RecordBatch.from_arrays([shard_, pack_, _binaries(keys.astype(np.uint32), bounds), docs_, base_, width_, pa.array(several, pa.binary())], names=["shard", "pack", "low", "docs", "base", "width", "several"])

    return run


def _recurring(batches):
    """Of each shard, the keys of two documents or more: to each pack that sent them, with the smallest document."""
    held: list[tuple] = []
    shard = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "pack", "low", "docs", "base", "width", "several"))):
            if row[0] != shard and held:
                if (found := _homes(shard, held)) is not None:
                    yield found
                held = []
            shard = row[0]
            held.append(row[1:])
    if held and (found := _homes(shard, held)) is not None:
        yield found


def _homes(shard: int, rows: list[tuple]) -> pa.RecordBatch | None:
    low = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
    docs = np.concatenate([np.frombuffer(r[2], {2: np.uint16, 4: np.uint32, 8: np.int64}[r[4]]).astype(np.int64) + r[3] for r in rows])
    ends = np.cumsum([len(r[1]) // 4 for r in rows])
    several = np.zeros(len(low), bool)
    for r, start in zip(rows, np.r_[0, ends[:-1]]):
        several[np.frombuffer(r[5], np.uint32).astype(np.int64) + start] = True
    order = np.argsort(low, kind="stable")
    new = np.r_[True, low[order][1:] != low[order][:-1]]
    first = np.flatnonzero(new)
    least, most = np.minimum.reduceat(docs[order], first), np.maximum.reduceat(docs[order], first)
    recurs = (least != most) | np.logical_or.reduceat(several[order], first)
    group = np.empty(len(low), np.int64)
    group[order] = np.cumsum(new) - 1
    chosen = np.flatnonzero(recurs[group])
    bounds = np.r_[0, np.searchsorted(chosen, ends)]
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return None
    bounds = np.r_[bounds[some], bounds[-1]]  # packs without any are empty ranges between
    packs = np.array([r[0] for r in rows], np.int64)[some]
    return pa.RecordBatch.from_arrays([pa.array(packs), pa.array(np.full(len(some), shard, np.int32)), _binaries(low[chosen], bounds), _binaries(least[group[chosen]], bounds)], names=["pack", "shard", "low", "homes"])


_PASSAGE = "kind int, home long, doc long, pack long, row int, start int, words binary"
PHRASE, PLACE = 0, 1


def _passages(window: int, bits: int, key_bits: int):
    """Runs of recurring windows of one home: phrases in the home itself, places to look at elsewhere."""

    def run(batches):
        windows = Windows(window, bits, key_bits)
        for batch in batches:
            for k, (pack, texts, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pack", "texts", "known")))):
                words, ends, starts, owner, keys = windows(texts)
                known.sort(key=lambda r: r["shard"])
                held = np.concatenate([np.frombuffer(r["low"], np.uint32).astype(np.uint64) | (np.uint64(r["shard"]) << _S[32]) for r in known])
                homes = np.concatenate([np.frombuffer(r["homes"], np.int64) for r in known])
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                found = np.flatnonzero(held[at] == keys)
                if not len(found):
                    continue
                starts, owner, homes = starts[found], owner[found], homes[at[found]]
                first = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (homes[1:] != homes[:-1]) | (owner[1:] != owner[:-1])])
                last = np.r_[first[1:], len(starts)] - 1
                docs = _numbers(batch, k)[owner[first]]
                kind = np.where(docs == homes[first], PHRASE, PLACE)
                begin = np.r_[0, ends[:-1]][owner[first]]
                said = [b" ".join(words[a : b + window]) for a, b in zip(starts[first].tolist(), starts[last].tolist())]
                columns = (kind.astype(np.int32), homes[first], docs, np.full(len(first), pack), owner[first].astype(np.int32), (starts[first] - begin).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(said, pa.binary())], names=["kind", "home", "doc", "pack", "row", "start", "words"])

    return run


class Automata:
    """Aho-Corasick automata over words, a character for each word; a new one begins when characters run out.

    Patterns are the grams of half a window that stand in a phrase one behind the other: every window of the phrase holds
    one of them whole, with one node of the automaton for each word instead of a window of nodes. Where one is found, the
    windows that hold it are compared with those of the phrases.
    """

    def __init__(self, window: int):
        self.window, self.gram, self.all = window, (window + 1) // 2, []

    def _letters(self, words: list[bytes]) -> str:
        letters = self.all[-1][0]
        for w in words:
            if w not in letters:
                k = len(letters) + 1  # 0 is for words that no phrase holds
                letters[w] = chr(k if k < 0xD800 else k + 0x800)
        return "".join(map(letters.__getitem__, words))

    def add(self, phrase: bytes, home: int) -> None:
        words = phrase.split(b" ")
        if not self.all or len(self.all[-1][0]) + len(words) > MOST_WORDS:
            self.all.append(({}, ahocorasick.Automaton(ahocorasick.STORE_LENGTH), {}))
        said, (_, automaton, homes) = self._letters(words), self.all[-1]
        for k in range(0, len(said) - self.gram + 1, self.gram):
            automaton.add_word(said[k : k + self.gram])
        for k in range(len(said) - self.window + 1):
            w = said[k : k + self.window]
            if homes.setdefault(w, home) > home:
                homes[w] = home

    def compile(self) -> None:
        for _, automaton, _ in self.all:
            automaton.make_automaton()

    def find(self, words: list[bytes]) -> dict[int, int]:
        """Starts of windows of phrases, with the smallest home."""
        found: dict[int, int] = {}
        last = len(words) - self.window
        for letters, automaton, homes in self.all:
            said = "".join([letters.get(w, "\0") for w in words])
            done = 0
            for end, _ in automaton.iter(said):
                for k in range(max(done, end + 1 - self.window), min(last, end + 1 - self.gram) + 1):
                    home = homes.get(said[k : k + self.window])
                    if home is not None and found.setdefault(k, home) > home:
                        found[k] = home
                done = max(done, end + 2 - self.gram)
        return found


_FOUND = "pack long, row int, low int, high int, doc long, unknown binary"


def _locate(window: int):
    """Word ranges to remove; windows of places that no phrase holds, with their words. Phrases come before places."""

    def run(batches):
        automata, compiled = Automata(window), False
        for batch in batches:
            out: list[tuple] = []
            for kind, home, doc, pack, row, start, said in zip(*(batch.column(c).to_pylist() for c in ("kind", "home", "doc", "pack", "row", "start", "words"))):
                if kind == PHRASE:
                    automata.add(said, home)
                    continue
                if not compiled:
                    automata.compile()
                    compiled = True
                words = said.split(b" ")
                found = automata.find(words)
                low = high = -1
                for k in range(len(words) - window + 1):
                    if (at := found.get(k)) is None:
                        out.append((pack, row, start + k, start + k + window, doc, b" ".join(words[k : k + window])))
                    elif at < doc:
                        if k > high:
                            if high >= 0:
                                out.append((pack, row, start + low, start + high, doc, None))
                            low = k
                        high = k + window
                if high >= 0:
                    out.append((pack, row, start + low, start + high, doc, None))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["pack", "row", "low", "high", "doc", "unknown"])

    return run


def _kept(batches):
    for batch in batches:
        for ids, texts, ranges in zip(*(batch.column(c) for c in ("ids", "texts", "ranges"))):
            texts, removed = texts.as_py(), {}
            for r in ranges.as_py() or ():
                removed.setdefault(r["row"], []).append((r["low"], r["high"]))
            rows = []
            for k, text in enumerate(texts):
                words, spans = (text or b"").split(), []
                for low, high in sorted(removed.get(k, ())):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(high, spans[-1][1])
                    else:
                        spans.append([low, high])
                kept, done = [], 0
                for low, high in spans:
                    kept += words[done:low]
                    done = high
                kept += words[done:]
                rows.append((len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept)))
            n_words, n_removed, spans, kept = zip(*rows)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def _dealt(passages: DataFrame) -> DataFrame:
    """passages with salt: places of a home that is copied very often go to many tasks, its phrases to all of those."""
    size = F.octet_length("words")
    sizes = passages.groupBy("home").agg(F.sum(F.when(F.col("kind") == PLACE, size).otherwise(0)).alias("places"), F.sum(F.when(F.col("kind") == PHRASE, size).otherwise(0)).alias("phrases"))
    salts = F.ceil(F.col("places") / F.greatest(F.lit(PLACE_BYTES), 4 * F.col("phrases"))).cast("int")
    # Staged, so that Spark can split a home that is everywhere.
    hot = stage(sizes.filter(salts > 1).select(F.col("home").alias("h_home"), salts.alias("salts")))
    held = passages.join(hot, F.col("home") == F.col("h_home"), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    one = F.array(F.pmod(F.hash("pack", "row", "start"), F.col("salts")))
    return held.withColumn("salt", F.explode(F.when(F.col("kind") == PLACE, one).otherwise(F.sequence(F.lit(0), F.col("salts") - 1)))).select("salt", *passages.columns)


def dedup_phrases(documents: DataFrame, window: int = WINDOW, key_bits: int = 32) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_removed, spans (removed word ranges), kept (text).

    A word is removed if a window covers it that also starts in a document with a smaller doc_id; windows are judged on
    the input. Rows of one doc_id never remove one another's words; a null doc_id comes before all others. Null texts
    have no words, texts of fewer than `window` words stay whole. An empty table gives an empty result. Columns besides
    doc_id and text are ignored. key_bits: of windows' keys in a shard; no result depends on it.
    """
    spark = documents.sparkSession
    shared_dir(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packs = stage(docs.mapInArrow(_pack, "pack long, ids array<long>, texts array<binary>, n_bytes long"))
    size = packs.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(size // SHARD_BYTES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = min(24, max(1, int(shards - 1).bit_length()))
    texts = packs.select("pack", "ids", "texts")
    keys = texts.mapInArrow(_keys(window, bits, key_bits), _KEYS)
    known = stage(keys.repartition("shard").sortWithinPartitions("shard").mapInArrow(_recurring, "pack long, shard int, low binary, homes binary"))
    by_pack = known.groupBy(F.col("pack").alias("k_pack")).agg(F.collect_list(F.struct("shard", "low", "homes")).alias("known"))
    passages = stage(texts.join(by_pack, F.col("pack") == F.col("k_pack")).select("pack", "ids", "texts", "known").mapInArrow(_passages(window, bits, key_bits), _PASSAGE))
    drop(known)
    phrases = passages.filter(F.col("kind") == PHRASE).agg(F.sum(F.octet_length("words"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), phrases // PHRASE_BYTES + 1)
    dealt = _dealt(passages).repartition(tasks, "home", "salt").sortWithinPartitions("kind")
    found = stage(dealt.mapInArrow(_locate(window), _FOUND))
    drop(passages)
    ranges = found.filter("unknown is null").select("pack", "row", "low", "high")
    unknown = found.filter("unknown is not null")
    if not unknown.isEmpty():
        least = unknown.groupBy(F.col("unknown").alias("l_unknown")).agg(F.min("doc").alias("least"))
        ranges = ranges.unionByName(unknown.join(least, F.col("unknown") == F.col("l_unknown")).filter(F.col("doc") > F.col("least")).select(*ranges.columns))
    by_pack = ranges.groupBy(F.col("pack").alias("r_pack")).agg(F.collect_list(F.struct("row", "low", "high")).alias("ranges"))
    held = texts.join(by_pack, F.col("pack") == F.col("r_pack"), "left").select("ids", "texts", "ranges")
    return held.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
