"""Full rankings of vectors: without a shuffle of pairs the same as by a window, and products as exact as sums in order."""

import random

import numpy as np
import pytest

from tessera.operators import dense


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_products_round_as_sums_in_order(metric):
    """Also where the seventh digit is a five, of equal rows, of large and of undefined components."""
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(300, 16)), rng.normal(size=(40, 16))
    v[:40], v[40:60] = q, q[:20] + 0.0005
    halves = np.zeros((80, 4)), np.zeros((2, 4))
    halves[0][:, 0], halves[0][:, 1], halves[1][1, :2] = np.arange(80) + 0.5, 1e-6 * np.arange(80), (1e-6, 0.5)
    odd = v[:9].copy()
    odd[0, 3], odd[1, 2] = np.nan, np.inf
    for a, b in ((v, q), halves, (v * 1e4, q * 1e4), (v * 1e7, q), (odd, q[:2]), (v[:0], q)):
        with np.errstate(all="ignore"):
            np.testing.assert_array_equal(dense._values(a, b, metric), dense._in_order(a, b, metric))


@pytest.mark.parametrize("held", [8_000_000, 150])
def test_full_rankings_equal_windows(spark, monkeypatch, held):
    """Ties, equal documents' chunks apart in the input, null vectors, null components and other lengths; no exchange holds a pair."""
    monkeypatch.setattr(dense, "HELD", held)
    monkeypatch.setattr(dense, "GIVEN", 17)
    rng = random.Random(2)
    vector = lambda: [float(rng.randrange(3)) for _ in range(3)]
    odd = [None, [1.0, None, 2.0], [1.0], [float("nan"), 0.0, 0.0]]
    chunks = [(n, f"d{n % 37:02}", odd[n % 4] if n % 37 in (1, 2, 5) else vector()) for n in range(120)]
    table = spark.createDataFrame(chunks, "chunk int, doc string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(n, vector()) for n in range(7)] + [(7, None), (8, [1.0, 2.0])], "question_id int, query array<float>")
    shown = lambda df: sorted(map(repr, (tuple(r) for r in df.select("question_id", "doc", "dist", "rnk").collect())))
    for keep in ("max", "min"):
        got = dense.full_ranking(table, queries, keep)
        assert shown(got) == shown(dense.ranked(dense.by_document(dense.distances(table, queries), keep)))
        assert "hashpartitioning" not in got._jdf.queryExecution().toString()
    alone = table.where("chunk < 37")
    got = dense.full_ranking(alone, queries)
    assert shown(got) == shown(dense.ranked(dense.distances(alone, queries)))
    monkeypatch.setattr(dense, "RANKED", 5)
    assert shown(dense.full_ranking(alone, queries)) == shown(got)
    assert dense.full_ranking(table.limit(0), queries).count() == 0
