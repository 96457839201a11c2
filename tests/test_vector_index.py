"""A written index, searched to an exact end."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector_index

CHUNKS, QUERIES = "chunk bigint, doc bigint, embedding array<float>", "question_id int, query array<float>"


def rows_of(v):
    return [(k, k // 2, [float(y) for y in x]) for k, x in enumerate(v)]


def plain(chunks, queries, k, metric):
    out = []
    for q, w in queries:
        scored = []
        for chunk, doc, v in chunks:
            if v is not None:
                a, b = np.array(v), np.array(w)
                scored.append((round(float(((a - b) ** 2).sum() if metric == "l2" else -(a @ b)), 6), doc, chunk))
        out += [(q, chunk, doc, d if metric == "l2" else -d, n + 1) for n, (d, doc, chunk) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def near_enough(got, want):
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(got, want))


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_search_is_exact_and_reads_few_cells(spark, tmp_path, metric):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 6)) * 4
    v = np.round(centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 6)) * 0.2, 2).astype(np.float32)
    v[200:400] = v[200]  # a crowd of ties
    chunks = [*rows_of(v), (9000, 1, None), (5, 2, [float(y) for y in v[5]])]
    queries = [(k, [float(y) for y in v[k * 90] + np.float32(0.01)]) for k in range(8)]
    path = str(tmp_path / metric)
    vector_index.write(spark.createDataFrame(chunks, CHUNKS).repartition(4), path, cells=30, metric=metric)
    index = vector_index.Index(spark, path)
    assert index.metric == metric and index.vectors.count() == 1501
    found = index.search(spark.createDataFrame([*queries, (99, None)], QUERIES), 12)
    near_enough(sorted(map(tuple, found.collect())), plain(chunks, queries, 12, metric))
    if metric == "l2":
        assert index.cells_read < 8 * 30 / 3


def test_a_search_reads_the_folders_of_its_cells_alone(spark, tmp_path):
    v = np.repeat(np.eye(8), 40, axis=0) * 10
    vector_index.write(spark.createDataFrame(rows_of(v), CHUNKS), str(tmp_path), cells=8)
    assert len(glob.glob(f"{tmp_path}/vectors/cell=*")) >= 4
    index = vector_index.Index(spark, str(tmp_path))
    one = index.search(spark.createDataFrame([(1, [9.0] + [0.0] * 7)], QUERIES), 5)
    assert [r["chunk"] for r in one.orderBy("rnk").collect()] == [0, 1, 2, 3, 4] and index.cells_read < 8
    chosen = spark.createDataFrame([(1, 0)], "question_id int, cell int")
    plan = index.read(chosen, spark.createDataFrame([(1, [0.0] * 8)], QUERIES))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan


def test_more_asked_than_there_is_and_nothing_at_all(spark, tmp_path):
    few = rows_of(np.arange(6.0).reshape(3, 2))
    vector_index.write(spark.createDataFrame(few, CHUNKS), str(tmp_path / "few"), cells=100)
    asked = spark.createDataFrame([(1, [0.0, 0.0])], QUERIES)
    assert vector_index.Index(spark, str(tmp_path / "few")).search(asked, 10).count() == 3
    vector_index.write(spark.createDataFrame([(1, 1, None)], CHUNKS), str(tmp_path / "none"))
    assert vector_index.Index(spark, str(tmp_path / "none")).search(asked, 10).collect() == []
    assert vector_index.Index(spark, str(tmp_path / "few")).search(asked.limit(0), 10).collect() == []
    with pytest.raises(ValueError):
        vector_index.write(asked, str(tmp_path), metric="cosine")
