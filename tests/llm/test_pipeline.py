"""The corpus pipeline against plain Python, and the SQL of the operators' queries."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from kitefin.llm import queries, secret_scan

from .test_jaccard_join import brute
from .test_row_operators import brute_hits, brute_quality, check_mix, documents, odd_documents


def without_secrets(text):
    found = secret_scan.find_secrets(text)
    for a, b in sorted(((a, b) for _, a, b in found), reverse=True):
        text = text[:a] + "\0" * (b - a) + text[b:]
    return re.sub("\0+", "<secret>", text)


def test_pipeline(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counted = {d.doc_id: brute_quality(d.text or "") for d in docs}
    # So few labels certify no cutoff, and the base alone decides.
    kept = [d for d in docs if counted[d.doc_id][0] >= 50 and 100 * counted[d.doc_id][4] <= 50 * counted[d.doc_id][0]]
    classes = brute([(d.doc_id, d.text) for d in kept])
    kept = [d for d in kept if classes[d.doc_id][1] == d.doc_id]
    bench = [(b.item_id, b.text) for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {h[0] for h in brute_hits([(d.doc_id, d.text) for d in kept], bench) if h[-1]}
    kept = [d for d in kept if d.doc_id not in hit]
    table, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES[:-1]:
        table = spark.createDataFrame(function(spark, table, sf_dir).collect(), table.schema)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append((name, table.count()))
    assert seen[-1][1] == seen[-2][1] and seen[0][1] < len(docs)
    left = {d.doc_id: d.text for d in table.collect()}
    assert left == {d.doc_id: without_secrets(d.text) for d in kept}
    check_mix(corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).collect(), table.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept)


def test_stages_with_odd_rows(spark, sf_dir):
    odd = odd_documents(spark).withColumns({"`a.b`": F.lit(1), "`x``y`": F.lit("z")})
    odd = odd.toDF(*[c.strip("`").replace("``", "`") for c in odd.columns])
    assert {"a.b", "x`y"} <= set(odd.columns)
    left = [8]
    for (name, function), want in zip(corpus_pipeline.STAGES[:-1], (0, 7, 8, 8)):
        out = function(spark, odd, sf_dir)
        assert out.columns == odd.columns
        assert out.count() == want, name
        assert function(spark, odd.limit(0), sf_dir).count() == 0
        left.append(want)
    assert corpus_pipeline.source_mixing(spark, odd, sf_dir).count() == 8


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = c.execute(queries.ORACLES[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*have).collect())) == sorted(found.fetchall())


def test_registry():
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in entry.queries()


def test_rows_without_ids_stand_by_their_own_texts(spark, sf_dir):
    """Rows with a null or a repeated doc_id go for what their own texts are."""
    long = lambda k: " ".join(f"w{k}x{x}" for x in range(80))
    made = [(None, "short"), (None, long(1)), (None, long(2)), (7, "short"), (7, long(3)), (3, long(4)), (None, long(4) + " end"), (9, long(5)), (9, long(5) + " end"), (None, long(6)), (None, long(6) + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t in made if t != "short")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    for group in ([(None, "short"), (7, "short")], [(9, long(5)), (9, long(5) + " end")], [(None, long(6)), (None, long(6) + " end")]):
        assert sum(x in left for x in group) == 1, group
    assert {(None, long(1)), (None, long(2)), (7, long(3)), (3, long(4))} <= set(left) and len(left) == 7
