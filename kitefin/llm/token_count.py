"""Token counts by rank-synchronous merging over ragged numpy arrays.

Texts are cut at white space, which no pre-token crosses; each distinct piece is normalised and pre-tokenised by
the tokenizer file's own rules once, the new pre-tokens of a group of texts are merged together as one flat array of
symbols, and in each round every sequence applies its lowest-ranked pair wherever it stands. Only the number of
symbols that survive is kept.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_groups

#: Distinct pieces that a worker remembers; beyond that it starts anew.
MOST_PIECES = 250_000
LIMIT = 2048
#: White space to str.split, but not to the tokenizer.
_ODD_BLANKS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")


class MergeTable:
    """The merges of a BPE vocabulary as a sorted array of pairs with their ranks and results."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab, self.size = vocab, max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        first = np.full(self.size, -1, np.int64)
        first[made[::-1]] = np.arange(len(made))[::-1]
        left, right = keys // self.size, keys % self.size
        if (np.maximum(first[left], first[right]) >= np.arange(len(keys))).any():
            raise ValueError("a merge comes before the ones that make its parts; equal ranks can't be applied together")

    def symbols(self, piece: str) -> list[int]:
        """Ids of a pre-token's characters, the last one with the end-of-word suffix."""
        v = self.vocab
        return [v[c] for c in piece[:-1]] + [v[piece[-1] + self.suffix]]

    def counts(self, sequences: list[list[int]]) -> np.ndarray:
        """Symbols left of each sequence after all merges."""
        out = np.array([len(s) for s in sequences], np.int64)
        ids = np.fromiter((x for s in sequences for x in s), np.int64, int(out.sum()))
        seq = np.repeat(np.arange(len(sequences)), out)
        absent = np.int64(len(self.keys))
        while len(ids) > 1:
            key = ids[:-1] * self.size + ids[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], absent)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, absent], starts)
            spread = np.repeat(lowest, np.diff(np.r_[starts, len(seq)]))
            hit = (rank == spread[:-1]) & (rank < absent)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            run = np.r_[True, np.diff(at) != 1]  # of pairs that overlap, as in a a a, every other one counts
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            ids[at] = self.made[rank[at]]
            out -= np.bincount(seq[at], minlength=len(out))
            keep = spread < absent  # sequences without a pair are done
            keep[at + 1] = False
            ids, seq = ids[keep], seq[keep]
        return out


class Counter:
    """Counts tokens as the tokenizer file's library does without special tokens added."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        told = json.loads(data)
        if told["model"]["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("only BPE files with plain added tokens are handled")
        library = Tokenizer.from_str(data.decode())
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.table, self.known, self.pieces = MergeTable(told["model"]), {}, {}
        added = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _split(self, text: str) -> tuple[list[str], int]:
        special = 0
        if self.added and (special := len(self.added.findall(text))):
            out: list[str] = []
            for part in self.added.split(text):
                out += self._split(part)[0]
            return out, special
        return ([x for x in _BLANKS.split(text) if x] if _ODD_BLANKS.search(text) else text.split()), 0

    def _learn(self, chunks: set[str]) -> None:
        cut = {c: [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(c))] for c in chunks}
        new = list({p for x in cut.values() for p in x if p} - self.pieces.keys())
        if new:
            self.pieces.update(zip(new, self.table.counts([self.table.symbols(p) for p in new]).tolist()))
        self.known.update((c, sum(self.pieces[p] for p in x if p)) for c, x in cut.items())

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self._split(t or "") for t in texts]
        new = set().union(*(x for x, _ in split)) - self.known.keys()
        if new:
            if len(self.known) > MOST_PIECES:
                self.known, self.pieces = {}, {}
                new = set().union(*(x for x, _ in split))
            self._learn(new)
        get = self.known.__getitem__
        return [sum(map(get, x)) + special for x, special in split]


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of documents: doc_id, n_bytes, n_tokens, over_limit.

    tokenizer_path names a BPE file of the tokenizers library; the driver reads it once (a few MB, whatever the
    data) and broadcasts it. Null texts count as empty; whole texts are counted, without truncation; repeated rows
    each give a row; an empty table gives an empty result; columns besides doc_id and text are ignored.
    """
    with open(tokenizer_path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = Counter(shared.value)
        for batch, texts in text_groups(batches, chars=1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter.count(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
