"""Vector code compression: product quantisation over integers by Lloyd's rounds with Hamerly's bounds.

Each component becomes an integer, each vector is cut into equal parts, and each part position has a codebook whose
entries start as the parts of the vectors with the smallest ids. Of every part the table of a round holds its code, one
upper bound of the distance to that entry and one lower bound of the distance to the second nearest. When entries have
moved, bounds are widened by what they moved; a part is only measured against all entries where the upper bound isn't
strictly below the lower one, nor below half the way from its entry to the nearest other, even after the upper bound is
made exact. Distances are compared as integers, so the least index wins every tie: with two nearest entries no bound is
strictly below the other. Bounds are rounded outwards at every step.

Vectors stay where they are: a round reads the table of the one before and writes its own, with one row of sums for each
code and task beside the vectors. What is sent around are the codebooks, of PARTS * ENTRIES entries whatever the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import drop, shared_dir, stage

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Vectors measured against all entries at once.
BLOCK = 4096
VECTOR, SUMS = 0, 1


def squares(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts to entries, both of integers. Products of floats are as exact while all fit."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * parts.shape[1] * most**2 < 1 << 53 else np.int64
    x, c = parts.astype(kind), book.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


class Book:
    """The entries of one part position, and what the bounds need: moves since the last round, half gaps."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = squares(entries, entries).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half_gap = _below(_below(np.sqrt(apart.min(axis=1, initial=np.inf))) / 2)
        moved = np.zeros(len(entries)) if before is None else _above(np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64)))
        self.moved = moved
        # The most that any entry but one's own has moved.
        order = np.argsort(moved)
        self.others = np.full(len(entries), moved[order[-1]] if len(order) else 0.0)
        if len(order):
            self.others[order[-1]] = moved[order[-2]] if len(order) > 1 else 0.0

    def assign(self, parts: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Brings codes and bounds up to date, in place; which parts were measured against all entries."""
        upper[:] = _above(upper + self.moved[code])
        lower[:] = _below(lower - self.others[code])
        bound = np.maximum(lower, self.half_gap[code])
        left = np.flatnonzero(~(upper < bound))
        own = ((parts[left] - self.entries[code[left]]) ** 2).sum(axis=1)
        # Without bounds yet, nothing is known of the code.
        upper[left] = np.where(np.isinf(upper[left]), np.inf, _above(np.sqrt(own.astype(np.float64))))
        left = left[~(upper[left] < bound[left])]
        for k in range(0, len(left), BLOCK):
            at = left[k : k + BLOCK]
            found = squares(parts[at], self.entries)
            code[at] = nearest = found.argmin(axis=1)
            rows = np.arange(len(at))
            upper[at] = _above(np.sqrt(found[rows, nearest].astype(np.float64)))
            found[rows, nearest] = np.iinfo(np.int64).max
            lower[at] = _below(np.sqrt(found.min(axis=1).astype(np.float64))) if found.shape[1] > 1 else np.inf
        measured = np.zeros(len(parts), bool)
        measured[left] = True
        return measured


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.reshape(-1)))


def _assign(shared, names: list[str], label_type: pa.DataType):
    """Vectors with new codes and bounds, and after a task's last vector the sums of its parts for each code."""

    def run(batches):
        books: list[Book] = shared.value
        parts_, (entries, width) = len(books), books[0].entries.shape
        members = np.zeros((parts_, entries), np.int64)
        sums = np.zeros((parts_, entries, width), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = batch.column("vector").flatten().to_numpy().reshape(n, parts_, width)
            new = batch.column("code").null_count == n
            code = np.zeros((parts_, n), np.int64)
            upper, lower = np.full((parts_, n), np.inf), np.full((parts_, n), -np.inf)
            scans = np.zeros(n, np.int64)
            if not new:
                code[:] = batch.column("code").flatten().to_numpy().reshape(n, parts_).T
                upper[:], lower[:] = (batch.column(c).flatten().to_numpy().reshape(n, parts_).T for c in ("upper", "lower"))
                scans += batch.column("n_scans").to_numpy()
            error = np.zeros(n, np.int64)
            for k, book in enumerate(books):
                own = np.ascontiguousarray(vectors[:, k])
                scans += book.assign(own, code[k], upper[k], lower[k])
                error += ((own - book.entries[code[k]]) ** 2).sum(axis=1)
                members[k] += np.bincount(code[k], minlength=entries)
                np.add.at(sums[k], code[k], own)
            held = {"kind": pa.array(np.full(n, VECTOR, np.int32)), "code": _lists(code.T.astype(np.int32)), "upper": _lists(upper.T.copy()), "lower": _lists(lower.T.copy()), "n_scans": pa.array(scans), "error": pa.array(error)}
            held |= {c: batch.column(c) for c in ("vec_id", "label", "vector")}
            yield _batch(held, names, n, label_type)
        part, entry = np.nonzero(members)
        if len(part):
            held = {"kind": pa.array(np.full(len(part), SUMS, np.int32)), "part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "members": pa.array(members[part, entry]), "sums": _lists(sums[part, entry])}
            yield _batch(held, names, len(part), label_type)

    return run


_KINDS = {"vec_id": pa.int64(), "vector": pa.list_(pa.int64()), "code": pa.list_(pa.int32()), "upper": pa.list_(pa.float64()), "lower": pa.list_(pa.float64()), "n_scans": pa.int64(), "error": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "members": pa.int64(), "sums": pa.list_(pa.int64())}


def _batch(held: dict, names: list[str], n: int, label_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([held[c] if c in held else pa.nulls(n, label_type if c == "label" else _KINDS[c]) for c in names], names=names)


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector of whole numbers; vectors that are null or hold null or non-finite components are dropped."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = embeddings.filter(vector.isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors and the final codebooks, an array of (entry, component) for each part.

    Codes: vec_id, label, vector (whole numbers), code (the entry of each part), error (of the vector), label_error (of
    all with its label, null labels together), n_scans (how often a part was measured against all entries).

    Dropped are vectors that are null or hold null or non-finite components. Codebooks start from the vectors with the
    smallest vec_ids, null after all others, equal ids in the order of their components; with fewer vectors than
    `entries` codebooks are smaller. Repeated rows count each. Vectors of different lengths, lengths that `parts`
    doesn't divide, and components whose distances leave 64 bits raise ValueError. An empty table has no codes and
    empty codebooks. Columns besides vec_id, embedding and label are ignored.
    """
    if not 1 <= entries <= 1 << 16:
        raise ValueError("codebooks have 1 to 65,536 entries")
    spark = embeddings.sparkSession
    shared_dir(spark)
    rows = stage(integers(embeddings, scale))
    size = F.size("vector")
    n, short, long, least, most = rows.agg(F.count("*"), F.min(size), F.max(size), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    if n and (short != long or not long or long % parts):
        raise ValueError(f"vectors of {short} to {long} components can't be cut into {parts} equal parts")
    width = (long or 0) // parts
    if n and width * (2 * max(-least, most)) ** 2 >= 1 << 62:
        raise ValueError("components are too large for exact distances")
    first = [r.vector for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()]
    whole = np.array(first, np.int64).reshape(len(first), parts, width)
    books = [Book(np.ascontiguousarray(whole[:, k])) for k in range(parts)]
    nothing = {"code": "array<int>", "upper": "array<double>", "lower": "array<double>", "n_scans": "long", "error": "long", "part": "int", "entry": "int", "members": "long", "sums": "array<long>"}
    state = rows.select(F.lit(VECTOR).alias("kind"), "*", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    if not n:
        return _with_label_errors(state), [b.entries for b in books]
    schema = StructType([state.schema[c] for c in state.columns])
    for field in schema:
        field.nullable = True
    label_type = rows.select("label").limit(0).toArrow().schema.field("label").type
    spoken = [c for c in state.columns if c != "kind"]
    last = rows
    for k in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)
        after = stage(state.mapInArrow(_assign(shared, state.columns, label_type), schema), "kind")
        drop(last)
        shared.unpersist()
        last, state = after, after.filter(F.col("kind") == VECTOR).select("kind", *spoken)
        if k < rounds:
            books = _moved(books, after, width)
    return _with_label_errors(state), [b.entries for b in books]


def _moved(books: list[Book], table: DataFrame, width: int) -> list[Book]:
    """Entries become the means of their parts, rounded down; those without parts stay."""
    totals = table.filter(F.col("kind") == SUMS).groupBy("part", "entry").agg(F.sum("members").alias("members"), *(F.sum(F.col("sums")[c]).alias(f"c{c}") for c in range(width)))
    new = [b.entries.copy() for b in books]
    for r in totals.collect():  # as many rows as the codebooks have entries
        new[r.part][r.entry] = [r[f"c{c}"] // r.members for c in range(width)]
    return [Book(after, before.entries) for after, before in zip(new, books)]


def _with_label_errors(state: DataFrame) -> DataFrame:
    sums = stage(state.groupBy(F.col("label").alias("e_label")).agg(F.sum("error").alias("label_error")))
    held = state.join(sums, F.col("label").eqNullSafe(F.col("e_label")), "left")
    return held.select("vec_id", "label", "vector", "code", "error", "label_error", "n_scans")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def digest(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
