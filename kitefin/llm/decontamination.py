"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts are normalised bytewise (A-Z lowered, everything that is no word byte becomes a blank, blanks squeezed),
scanned once, and hits are mapped back to code points of the original text. The automaton's patterns are
collected in blocks of at most ``MAX_PATTERN_CHARS`` characters; a benchmark within one block, as usual, means
one pass over the texts, and a larger one means one pass for each block, with the hits so far carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir, text_groups, text_key

WINDOW = 10
#: What one automaton and its broadcast may hold; an item of b bytes has about WINDOW * b pattern characters.
MAX_PATTERN_CHARS = 8_000_000

#: Bytes to normalised bytes: digits, a-z and everything from 0x80 stay, A-Z are lowered, the rest become blanks.
_NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

OUTPUT = "doc_id long, text_key long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
CARRIED = "doc_id long, text_key long, text string, hits array<long>, items array<string>"


def normalise(text: str) -> list[bytes]:
    """Words of a text; invalid surrogates cannot occur in Spark's strings."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(text: str | None, window: int = WINDOW) -> Iterator[str]:
    """The windows of one item as automaton patterns, with a blank at either end."""
    words = normalise(text or "")
    for k in range(max(1, len(words) - window + 1) if words else 0):
        yield (b" " + b" ".join(words[k : k + window]) + b" ").decode("latin-1")


def pattern_blocks(items: DataFrame, window: int, most: int) -> Iterator[dict[str, list[str]]]:
    """Blocks of pattern -> item ids, streamed to the driver one partition at a time."""
    block: dict[str, set] = {}
    held = 0
    for row in items.toLocalIterator():
        for pattern in windows(row.text, window):
            if pattern not in block:
                if held + len(pattern) > most and block:
                    yield {k: sorted(v) for k, v in block.items()}
                    block, held = {}, 0
                block[pattern] = set()
                held += len(pattern)
            if row.item_id is not None:
                block[pattern].add(row.item_id)
    yield {k: sorted(v) for k, v in block.items()}


class Scanner:
    def __init__(self, block: dict[str, list[str]]):
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in block.items():
            self.automaton.add_word(pattern, (len(pattern), pattern.count(" ") - 1, ids))
        self.empty = not block
        if block:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (end exclusive, sorted, may overlap) and the items they belong to."""
        if self.empty or not words:
            return [], set()
        norm = b" " + b" ".join(words) + b" "
        found = [(end - n[0] + 1, n[1], n[2]) for end, n in self.automaton.iter(norm.decode("latin-1"))]
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 0x20)
        first = np.searchsorted(blanks, [x[0] for x in found]).tolist()
        return sorted((a, a + x[1]) for a, x in zip(first, found)), {i for x in found for i in x[2]}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Code-point spans of word runs; only texts with hits come here."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pattern_chars: int = MAX_PATTERN_CHARS) -> DataFrame:
    """One row for each row of documents: doc_id, text_key, n_words, n_hit, items (sorted ids), spans (hit runs, code points).

    documents needs doc_id and text, benchmark item_id and text; other columns are ignored, whatever their names.
    Null or empty texts have no words and no hits; repeated rows each give a row; items with a null id still make
    words hit but aren't listed; an empty benchmark hits nothing. Texts of any length are scanned whole.
    """
    spark = documents.sparkSession
    shared_dir(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text")
    blocks = pattern_blocks(items, window, max_pattern_chars)
    block, first = next(blocks), True
    while True:
        after = next(blocks, None)
        docs = docs.mapInArrow(_pass(spark.sparkContext.broadcast(block), first, after is None), OUTPUT if after is None else CARRIED)
        if after is None:
            return docs
        docs, block, first = docs.checkpoint(), after, False


def _pass(shared, first: bool, last: bool):
    """One scan of all texts; hits of earlier blocks come in and go out as flat lists of word ranges."""

    def run(batches):
        scanner = Scanner(shared.value)
        for batch, texts in text_groups(batches):
            columns: list[list] = [[], [], [], []]
            before = [([], [])] * len(texts) if first else zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist())
            for text, (hits, ids) in zip(texts, before):
                words = normalise(text or "")
                found, more = scanner.scan(words)
                runs, items = merged(found + list(zip(hits[::2], hits[1::2]))), sorted(more | set(ids))
                row = (len(words), sum(b - a for a, b in runs), items, original_spans(text, runs) if runs else []) if last else (text, [x for r in runs for x in r], items, None)
                for column, value in zip(columns, row):
                    column.append(value)
            ids = [batch.column(c) for c in ("doc_id", "text_key")]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))] if last else [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
            names = ["doc_id", "text_key", *(["n_words", "n_hit", "items", "spans"] if last else ["text", "hits", "items"])]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return run
