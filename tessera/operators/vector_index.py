"""A vector index that is written once and searched: coarse cells as folders, and an exact end of the search.

`write` cuts vectors into the cells of a k-means fit on a bounded sample; every vector is in the index. Cells are folders (partitions by `cell`), so that a
search reads the cells that it names and no other. Beside them stand the centres, each with its cell's count and radius.

A search reads the nearest cells of each query first. The k-th distance found so far bounds what can still matter: a cell whose centre is at distance
d and whose radius is R holds nothing nearer than d - R (and no inner product above that with the centre plus R times the query's length). Cells
within the bound are read in a second step, the others never, and the result is that of a full scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stages import written
from .dense import dot, doubles, nearest, squared_distance

METRICS = ("l2", "ip")
#: Cells at most: their centres, counts and radii are read by the driver. Vectors that the fit takes for each cell.
MOST_CELLS, SAMPLE = 4096, 64
#: Distances are compared as they are shown, to six digits.
ROUNDING = 1e-6


def write(chunks: DataFrame, path: str, cells: int = 100, metric: str = "l2", seed: int = 7) -> None:
    """chunks (chunk, doc, embedding) as an index at path. Null vectors are left out; repeated rows stay; without vectors there is no cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = chunks.sparkSession
    rows = chunks.where("embedding IS NOT NULL").select("chunk", "doc", "embedding")
    count = rows.count()
    cells = max(1, min(cells, MOST_CELLS, count))
    # Rows by a hash: the fit takes at most SAMPLE vectors a cell, whatever the table's size; a few more than needed on average.
    part = min(1.0, 1.2 * cells * SAMPLE / max(1, count))
    sample = rows.where(F.pmod(F.xxhash64("chunk", "doc", F.lit(seed)), F.lit(1_000_000)) < int(part * 1_000_000)).limit(cells * SAMPLE)
    sample = written(sample.select(array_to_vector(doubles("embedding")).alias("_v")), "index-sample") if count else None
    model = KMeans(k=cells, seed=seed, featuresCol="_v", maxIter=10).fit(sample) if count and sample.count() else None
    centres = [[float(x) for x in c] for c in model.clusterCenters()] if model else []
    placed = _placed(rows, centres)
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # folders by cell have no file where there is no row
    kept = _read(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    table = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    table.join(kept, "cell").withColumn("metric", F.lit(metric)).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def _placed(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """rows with the nearest centre's cell and how far it is, a matrix product a batch; rows lie by cell, a large one in several tasks."""
    import numpy as np
    import pyarrow as pa

    if not centres:
        return rows.limit(0).withColumns({"cell": F.lit(0), "away": F.lit(0.0)})
    c = np.array(centres)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for b in batches:
            v = np.array(b.column("embedding").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            d = (v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * (v @ c.T) if b.num_rows else np.zeros((0, len(c)))
            at = d.argmin(1)
            away = np.sqrt(((v - c[at]) ** 2).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.record_batch([*b.columns, pa.array(at, pa.int32()), pa.array(away)], [*b.schema.names, "cell", "away"])

    placed = rows.mapInArrow(run, f"{kinds}, cell int, away double")
    return placed.hint("rebalance", "cell")


class Index:
    """An index at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.vectors = _read(spark, path)
        self.centres = spark.read.parquet(f"{path}/centres")
        first = self.centres.select("metric").first()
        self.metric = first[0] if first else "l2"

    def bounds(self, queries: DataFrame) -> DataFrame:
        """queries (question_id, query): question_id, cell, n, and the best value that the cell can hold, the less the better."""
        # One row of MOST_CELLS centres at most.
        listed = self.centres.agg(F.collect_list(F.struct("cell", "centre", "radius", "n")).alias("_c"), F.lit(0).alias("_k"))
        near = queries.withColumn("_k", F.lit(0)).join(F.broadcast(listed), "_k").select("question_id", "query", F.inline("_c"))
        if self.metric == "l2":
            least = F.greatest(F.sqrt(squared_distance("query", "centre")) - F.col("radius") * (1 + 1e-9) - 1e-9, F.lit(0.0))
            best = least * least
        else:
            best = -(dot("query", "centre") + F.sqrt(dot("query", "query")) * (F.col("radius") * (1 + 1e-9) + 1e-9))
        return near.select("question_id", "cell", "n", best.alias("best"))

    def read(self, chosen: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        """chosen (question_id, cell): question_id, chunk, doc, dist (less is better), rnk of the k best vectors of these cells, which alone are read."""
        cells = [r[0] for r in chosen.select("cell").distinct().collect()]  # MOST_CELLS at most
        out = nearest(self.vectors.where(F.col("cell").isin(cells)), queries, k, self.metric, chosen)
        return out if self.metric == "l2" else out.withColumn("dist", -F.col("dist"))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 1) -> DataFrame:
        """queries (question_id, query), a stated set: the k nearest chunks of each, exactly: question_id, chunk, doc, dist, rnk.

        dist is the squared distance, or the inner product; ties by document, then chunk. `probes` cells are read first, then as many more as hold k vectors.
        """
        queries = written(queries.where("query IS NOT NULL").select("question_id", "query"), "index-queries")
        bounds = written(self.bounds(queries), "index-bounds")
        order = Window.partitionBy("question_id").orderBy("best", "cell")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = bounds.withColumns({"_r": F.row_number().over(order), "_before": before}).where((F.col("_r") <= probes) | (F.col("_before") < k)).select("question_id", "cell")
        first = written(first, "index-first")
        found = written(self.read(first, queries, k), "index-found")
        limit = found.groupBy("question_id").agg(F.max("dist").alias("limit"), F.count(F.lit(1)).alias("got"))
        # Cells within the k-th distance, as distances are rounded.
        more = bounds.join(first, ["question_id", "cell"], "left_anti").join(limit, "question_id", "left")
        more = written(more.where((F.coalesce("got", F.lit(0)) < k) | (F.col("best") <= F.col("limit") + ROUNDING)).select("question_id", "cell"), "index-more")
        out = _best(found.unionByName(self.read(more, queries, k)).drop("rnk"), k)
        self.cells_read = first.count() + more.count()
        return out if self.metric == "l2" else out.withColumn("dist", -F.col("dist"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy("dist", "doc", "chunk")
    return rows.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
