"""Every oracle's query is registered, and entry points work on the smallest tables."""

import __spark_entry__ as entry


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["lo", "hi", "relation", "rank_ppr", "rank_time", "rank_sem", "score", "rnk"] and out.count() > 0
