"""Tables that grow are joined by key: a broadcast would pass them through the driver."""

import pytest

from kitefin.operators import iterate
from kitefin.plans import queries as graph_queries


@pytest.mark.parametrize("name", ["components", "component_rank", "recommend", "recommend_rollup", "init_reach", "makefile_descent"])
def test_plans_without_broadcast(spark, sf_dir, name):
    plan = graph_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # Counts of parts, of which there are few, are all that may be sent around.
    assert plan.count("BroadcastHashJoin") <= (1 if name == "component_rank" else 0)


def test_large_ways_without_broadcast(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "e")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "name string")
    for found in (iterate.components(edges, nodes, small_edges=0), iterate.peel(edges, nodes, small_edges=0), iterate.strong_components(edges, small_edges=0)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
