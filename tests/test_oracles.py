"""Every query that has a SQL oracle, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kitefin.plans import queries as graph_queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_graph_query_has_an_oracle():
    assert graph_queries.QUERIES.keys() == graph_queries.ORACLES.keys()
    assert entry.queries().keys() >= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(graph_queries.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    df = graph_queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.select(*columns).toArrow().to_pylist()]
    found = duck.execute(graph_queries.ORACLES[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == columns
    want = [tuple(r[have.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["subsystem", "SUBGRAPH", "INTERFACE", "DELETE", "NORMAL"] and df.count() > 0
