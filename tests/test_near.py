"""Pairs of near vectors against all products."""

import numpy as np
import pytest

from tessera.operators import near, resolve

ROWS = "id bigint, embedding array<float>"


def clustered(n, d, spread, seed, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * spread


def plain(v, eps, ids=None):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    a, b = np.nonzero(np.round(u @ u.T, 6) >= 1 - eps)
    ids = np.arange(len(v)) if ids is None else ids
    return sorted({(int(ids[x]), int(ids[y])) for x, y in zip(a, b) if ids[x] < ids[y]})


@pytest.mark.parametrize("spread,eps", [(0.05, 0.02), (0.4, 0.2), (1.0, 0.6), (0.2, 1.2)])
def test_pairs_are_those_of_all_products(spark, spread, eps):
    v = clustered(500, 8, spread, 1).astype(np.float32).astype(np.float64)
    v[7] = 0
    v[100:160] = v[100]  # a crowd of equal vectors
    rows = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)] + [(900, None)], ROWS).repartition(4)
    got = sorted(map(tuple, near.near_pairs(rows, eps, block=40).collect()))
    assert len(set(got)) == len(got) and got == plain(v, eps)


def test_a_forest_has_the_components_of_all_pairs(spark):
    v = clustered(300, 6, 0.1, 2)
    rows = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], ROWS)
    every = near.near_pairs(rows, 0.05, block=32)
    few = near.near_pairs(rows, 0.05, forest=True, block=32)
    comps = lambda pairs: sorted(map(tuple, resolve.components(pairs).collect()))
    assert comps(every) == comps(few) and few.count() < every.count()


def test_most_pairs_of_separate_clusters_are_not_compared(spark):
    v = clustered(4000, 16, 0.03, 3, centres=40)
    rows = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], ROWS)
    cells = near.celled(rows, 0.05, block=100)
    assert cells.all_pairs == 4000 * 3999 // 2 and cells.compared < 0.25 * cells.all_pairs


def test_few_or_no_vectors(spark):
    assert near.near_pairs(spark.createDataFrame([], ROWS), 0.5).collect() == []
    assert near.near_pairs(spark.createDataFrame([(1, None)], ROWS), 0.5).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], ROWS)
    assert sorted(map(tuple, near.near_pairs(twice, 0.1).collect())) == [(1, 2), (1, 2)]
    named = spark.createDataFrame([("b", [1.0]), ("a", [3.0])], "id string, embedding array<double>")
    assert [tuple(r) for r in near.near_pairs(named, 0.1, block=1).collect()] == [("a", "b")]


def test_wide_blocks_where_cells_leave_out_little(spark, monkeypatch):
    """Vectors all about: blocks become wide and products are made in strips, floats stay floats; the pairs are those of all."""
    monkeypatch.setattr(near, "STRIP", 7)
    v = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, embedding array<float>")
    assert near.celled(rows, 0.6, block=20).rows.schema["v"].dataType.simpleString() == "array<float>"
    seen = []
    plain = near.celled
    monkeypatch.setattr(near, "celled", lambda rows, eps, block, most: seen.append(block) or plain(rows, eps, block, most))
    got = {tuple(r) for r in near.near_pairs(rows, 0.6, block=20, wide=90).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(np.round(u @ u.T, 6) >= 0.4, 1))
    assert got == set(zip(a.tolist(), b.tolist())) and seen == [20, 90]
