"""Periods that overlap, against a loop over all pairs."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tessera.operators import graph, intervals

ROWS, ASKED = "id int, start date, end date", "question_id int, q_start date, q_end date"
ZERO = date(1999, 12, 20)


def plain(rows, asked):
    out = []
    for q, c, d in asked:
        for i, a, b in rows:
            if a is None or (c is not None and a <= (d or c) and c <= (b or date(9999, 12, 31))):
                out.append((i, q))
    return sorted(out)


def periods(n, seed, most=400):
    random.seed(seed)
    at = lambda: random.choice([None, *[ZERO + timedelta(random.randrange(most))] * 5])
    return [(k, at(), at()) for k in range(n)]


def test_overlapping_against_all_pairs(spark):
    """Null starts and ends on both sides, and periods that end before they begin."""
    rows, asked = periods(400, 1), periods(120, 2)
    rows += [rows[0], (900, date(1, 1, 1), date(9999, 12, 31)), (901, date(9999, 12, 31), None), (902, date(1, 1, 1), date(1, 1, 1))]
    asked += [(900, date(1, 1, 1), date(9999, 12, 31)), (901, date(9999, 12, 31), None), (902, date(1, 1, 1), None)]
    table = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("_node", "level")})
    got = intervals.overlapping(spark.createDataFrame(asked, ASKED), table)
    assert sorted(tuple(r) for r in got.select("id", "question_id").collect()) == plain(rows, asked)


def test_empty_sides(spark):
    rows, none = spark.createDataFrame(periods(9, 3), ROWS), spark.createDataFrame([], ASKED)
    assert intervals.overlapping(none, rows).count() == 0
    assert intervals.overlapping(spark.createDataFrame(periods(9, 3), ASKED), rows.limit(0)).count() == 0


def test_a_cover_is_the_period_in_few_nodes(spark):
    random.seed(4)
    spans = [(a, a + n) for a in (0, 1, 3, 4, 63, 730_119, 3_652_058) for n in (-1, 0, 1, 2, 3, 4, 15, 16, 30, 364, 5_000, 400_000) if a + n <= 3_652_058]
    got = spark.createDataFrame(spans, "a int, b int").select("a", "b", intervals.cover(F.col("a"), F.col("b")).alias("c")).collect()
    for a, b, nodes in got:
        held = sorted((i >> 8 << 2 * (i & 255), (i >> 8) + 1 << 2 * (i & 255)) for i in nodes)
        assert all(x[1] == y[0] for x, y in zip(held, held[1:]))  # apart, without gaps
        assert not nodes if b < a else (held[0][0], held[-1][1]) == (a, b + 1)
        assert len(nodes) <= 6 * intervals.LEVELS + 4


def test_filter_needs_no_window(spark):
    rows = spark.createDataFrame([(1, "a", "2001", "2002"), (1, "b", "2005", None), (2, "a", "2001", "2002")], "q int, id string, start string, end string")
    out = graph.time_filter(rows, ["q"], "start", "end", F.lit("2004"), F.lit("2006"))
    assert sorted(tuple(r)[:2] for r in out.collect()) == [(1, "b"), (2, "a")]
    whole = graph.time_filter(rows, [], "start", "end", F.lit("2004"), F.lit("2006"))
    assert [r["id"] for r in whole.collect()] == ["b"] and whole.columns == rows.columns
    assert "Window" not in whole._jdf.queryExecution().toString()
    assert graph.time_filter(rows.limit(0), ["q"], "start", "end", F.lit("2004"), F.lit("2006")).count() == 0


def test_rows_are_never_broadcast(spark):
    """A small file of rows whose nodes are many: the questions go to the rows, or both are shuffled."""
    table, asked = spark.createDataFrame(periods(50, 4), ROWS).limit(50), spark.createDataFrame(periods(5, 5), ASKED)
    few = intervals.FEW
    try:
        for intervals.FEW, sides in ((few, {"BuildRight"}), (0, set())):
            plan = intervals.overlapping(asked, table)._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
            assert {side for x in joins for side in ("BuildLeft", "BuildRight") if side in x} == sides
            got = intervals.overlapping(asked, table).select("id", "question_id").collect()
            assert sorted(map(tuple, got)) == plain(periods(50, 4), periods(5, 5))
    finally:
        intervals.FEW = few
