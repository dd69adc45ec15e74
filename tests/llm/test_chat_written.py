"""op8 goes through the examples that are written out, and notices what is wrong with them."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from kitefin.llm import chat_format, queries


def test_rows_come_from_written_examples(spark, sf_dir, monkeypatch):
    called = []
    monkeypatch.setattr(chat_format, "examples", lambda *a, f=chat_format.examples, **b: called.append(a) or f(*a, **b))
    queries.op8_chat_format(spark, sf_dir)
    assert len(called) == 1


def test_written_examples_read_back(spark):
    made = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (2, 0, "user", "x"), (3, 0, "assistant", "")]
    written = chat_format.examples(chat_format.expand(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")), rest=True)
    assert sorted((r.conv_id, r.position, len(chat_format.parse(r.text)), r.loss_start is not None) for r in written.collect()) == [(1, 1, 2, True), (1, 3, 4, True), (1, 4, 5, False), (2, 0, 1, False), (3, 0, 1, True)]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_examples(written).collect()}
    assert got == {1: (5, 2), 2: (1, 0), 3: (1, 0)}
    broken = written.withColumn("text", F.when(F.col("position") == 3, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    with pytest.raises(PythonException, match="does not begin"):
        chat_format.read_examples(broken).collect()
