"""Few nodes that meet large tables: what is large stays where it is read."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph


@pytest.fixture
def no_guess(spark):
    """Spark broadcasts nothing by its own estimate."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_edges_are_not_shuffled(spark, no_guess):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}", n) for n in range(300)]
    table = spark.createDataFrame(edges, "lo string, hi string, pos int")
    seeds = [(q, f"n{rng.randrange(60):02}") for q in range(4) for _ in range(2)]
    ball = graph.ball(table, spark.createDataFrame(seeds, "question_id int, node string"))
    both = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    want = set(seeds) | {(q, b) for q, s in seeds for a, b in both if a == s}
    assert {tuple(r) for r in ball.collect()} == want and "SortMergeJoin" not in plan(ball)
    some = graph.of_known(table, ball, "lo", "hi")
    known = {n for _, n in want}
    assert sorted(map(tuple, some.select("lo", "hi", "pos").collect())) == sorted(e for e in edges if e[0] in known and e[1] in known) and "Exchange hash" not in plan(some)
    inside = sorted(map(tuple, graph.induced(table, ball).select("question_id", "lo", "hi", "pos").collect()))
    assert inside == sorted((q, *e) for q in range(4) for e in edges if (q, e[0]) in want and (q, e[1]) in want)
    # Rows of others leave before a distinct.
    bridge = table.select(F.col("lo").alias("node"), F.col("hi").alias("passage")).union(table.select("hi", "lo")).distinct()
    told = graph.of_known(bridge, ball.where("question_id = 0"), "node")
    assert {tuple(r) for r in told.select("node", "passage").collect()} == {(a, b) for a, b in both if (0, a) in want}
    before_exchange = plan(told).split("Exchange hash")[1]
    assert "BroadcastHashJoin" in before_exchange and "BroadcastHashJoin" not in plan(told).split("Exchange hash")[0]


def test_many_known_nodes_are_joined(spark, monkeypatch, no_guess):
    monkeypatch.setattr(graph, "FEW", 3)
    rows = spark.range(50).select(F.col("id").cast("string").alias("node"))
    found = graph.of_known(rows, rows.where("CAST(node AS INT) % 3 = 0"), "node")
    assert {r.node for r in found.collect()} == {str(n) for n in range(0, 50, 3)} and "BroadcastHashJoin" not in plan(found)
