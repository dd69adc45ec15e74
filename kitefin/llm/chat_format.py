"""Chat formatting by prefix-target expansion.

Every turn becomes a formatted piece; a conversation's formatted text is its pieces in order. Every assistant turn
is an example of its own: its text is the formatted conversation from the start up to the end of that turn, and only
the reply inside the turn is trainable. `expand` has the pieces with an example's offsets (`example_end`, `loss_start`,
`loss_end`); `examples` writes every example out, a row for each, from which the query reads back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import GROUP_CHARS

#: The template: TURN role BODY text END, with a line break after END.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"
#: Backslashes are looked at from the start of a run and once, so that long runs take linear time.
_CONTROL = re.compile(r"(?<!\\)(\\*+)(<\|(?:turn|text|end)\|>)")
_TAIL = re.compile(r"(?<!\\)\\++\Z")


def escape(text: str) -> str:
    """An odd number of backslashes before a control string makes it text; what stands before one is doubled."""
    return _TAIL.sub(lambda m: m[0] * 2, _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text))


def unescape(text: str) -> str:
    return _TAIL.sub(lambda m: m[0][: len(m[0]) // 2], _CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text))


def escaped(column: Column) -> Column:
    """`escape` as a column."""
    return F.regexp_replace(F.regexp_replace(column, F.lit(_CONTROL.pattern), F.lit(r"$1$1\\$2")), F.lit(r"(?<!\\)\\++\z"), F.lit("$0$0"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text; raises ValueError on anything else."""
    marks = [(m.start(2), m.end(2), m[2]) for m in _CONTROL.finditer(formatted) if len(m[1]) % 2 == 0]
    if len(marks) % 3 or any(m[2] != (TURN, BODY, END)[k % 3] for k, m in enumerate(marks)):
        raise ValueError("control strings out of order")
    turns, done = [], 0
    for a, b, c in zip(marks[::3], marks[1::3], marks[2::3]):
        if formatted[done : a[0]] != ("\n" if done else ""):
            raise ValueError("text outside a turn")
        turns.append((unescape(formatted[a[1] : b[0]]), unescape(formatted[b[1] : c[0]])))
        done = c[1]
    if formatted[done:] != ("\n" if done else ""):
        raise ValueError("text outside a turn")
    return turns


def expand(conversations: DataFrame) -> DataFrame:
    """One row a turn, in any order: conv_id, position, turn, piece, example_end, loss_start, loss_end.

    position counts a conversation's turns from 0, by turn (null first), then role, then text. An assistant row is
    an example: the conversation's pieces up to its own, `example_end` code points, of which [loss_start, loss_end)
    is trainable; for other rows these three are null. Null texts and roles count as empty; repeated rows are turns
    of their own; a null conv_id is a conversation; an empty table has no rows. Other columns are ignored.
    """

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    head, body = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY)), escaped(F.col("text"))
    sized = rows.withColumns({"a": F.length(head).cast("long"), "b": (F.length(head) + F.length(body)).cast("long")}).withColumn("n", F.col("b") + len(END) + 1)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("end", F.sum("n").over(order)).withColumn("position", F.count("*").over(order) - 1)
    start = F.col("end") - F.col("n")
    trained = lambda c: F.when(F.col("role") == TRAINED_ROLE, c)
    return placed.select("conv_id", "position", "turn", F.concat(head, body, F.lit(END + "\n")).alias("piece"), trained(F.col("end")).alias("example_end"), trained(start + F.col("a")).alias("loss_start"), trained(start + F.col("b")).alias("loss_end"))


def examples(expanded: DataFrame, rest: bool = False) -> DataFrame:
    """The examples of `expand` written out: conv_id, position, text, loss_start, loss_end, one row for each reply.

    With rest, a conversation whose last turn is no reply has one row more, of all its turns and nothing trainable (null). The output
    grows with the square of a conversation's turns. A conversation's rows meet in one task in order and leave it in that
    order; only the text up to the turn at hand is in memory.
    """

    def run(batches):
        conv, parts, open_ = None, [], None
        for batch in batches:
            out: list[tuple] = []
            chars = 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "piece", "loss_start", "loss_end"))):
                if row[1] == 0 or row[0] != conv:
                    if rest and open_ is not None:
                        out.append((conv, open_, "".join(parts), None, None))
                        chars += len(out[-1][2])
                    conv, parts = row[0], []
                parts.append(row[2])
                open_ = row[1]
                if row[3] is not None:
                    parts, open_ = ["".join(parts)], None
                    out.append((conv, row[1], parts[0], row[3], row[4]))
                    chars += len(parts[0])
                if chars > GROUP_CHARS:
                    yield _example_rows(out)
                    out, chars = [], 0
            if out:
                yield _example_rows(out)
        if rest and open_ is not None:
            yield _example_rows([(conv, open_, "".join(parts), None, None)])

    rows = expanded.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "position", "piece", "loss_start", "loss_end")
    return rows.mapInArrow(run, "conv_id long, position long, text string, loss_start long, loss_end long")


def _example_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "position", "text", "loss_start", "loss_end"])


def read_back(expanded: DataFrame) -> DataFrame:
    """`read_examples` of the examples of `expand`, with the rest."""
    return read_examples(examples(expanded, rest=True))


def read_examples(written: DataFrame) -> DataFrame:
    """Digests of what `examples` has written, one row a conversation; see the README for the columns.

    An example begins with the conversation's one before it, which is compared, and the turns behind that are parsed. Rows
    are read as a stream, in the order in which `examples` leaves them: only two examples are in memory.
    """

    def run(batches):
        state, text, last, rows = None, "", -1, []
        for batch in batches:
            for conv, position, now, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "text", "loss_start", "loss_end"))):
                if state is None or state["conv_id"] != conv or position <= last:
                    if state:
                        rows.append(state)
                    state, text = {"conv_id": conv, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}, ""
                if not now.startswith(text):
                    raise ValueError("an example does not begin with the one before it")
                for role, said in parse(now[len(text) :]):
                    state["n_turns"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                if a is not None:
                    reply = unescape(now[a:b])
                    state["loss_chars"] += len(reply)
                    state["loss"].update(reply.encode())
                text, last = now, position
                state["formatted_chars"] = len(now)
            if rows:
                yield _digests(rows)
                rows = []
        if state:
            yield _digests([state])

    return written.select("conv_id", "position", "text", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[dict]) -> pa.RecordBatch:
    long = lambda k: pa.array([r[k] for r in rows], pa.int64())
    text = lambda k: pa.array([r[k].hexdigest() for r in rows], pa.string())
    return pa.RecordBatch.from_arrays([long("conv_id"), long("n_turns"), text("turns"), long("loss_chars"), text("loss"), long("formatted_chars")], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
