"""Pairs of vectors within a cosine distance, exactly, without comparing all pairs.

Vectors of length 1 have cosine distance eps or less if they lie within sqrt(2 eps) of each other. Every vector has its home in the cell of the nearest of
some pivots, and is a guest of each later cell that may hold a vector within that radius. A cell can hold none:

* if the plane between the two pivots is further than the radius (whatever lies beyond it is);
* or if the vector's distance to the cell's pivot differs by more than the radius from that of every vector at home there (triangle inequality).

Pairs are sought within cells alone: home with home, home with guests. Pivots are centres of a bounded sample; they decide the work and not the result.
A cell is cut into blocks, so that a crowd of near copies is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import written

#: Vectors a block, pivots at most, and vectors of the sample for each pivot.
BLOCK, MOST_PIVOTS, SAMPLE = 2000, 1024, 16
#: Vectors a block where cells leave out less than half of the pairs, which makes fewer copies of vectors; rows of a product at a time.
WIDE, STRIP = 8000, 512


@dataclass(frozen=True)
class Cells:
    """rows (id, v, home, guest array of cells) and counts, one (cell, home, guests) each."""

    rows: DataFrame
    counts: list[tuple[int, int, int]]

    @property
    def compared(self) -> int:
        """Pairs that are compared."""
        return sum(n * (n - 1) // 2 + n * g for _, n, g in self.counts)

    @property
    def all_pairs(self) -> int:
        n = sum(n for _, n, _ in self.counts)
        return n * (n - 1) // 2


def unit_rows(column) -> np.ndarray:
    if len(set(pc.unique(pc.list_value_length(column)).to_pylist())) > 1:
        raise ValueError("vectors differ in length")
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = v.reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def pivots_of(vectors: DataFrame, count: int) -> np.ndarray:
    """Centres of the sample that a hash picks, by a few rounds of k-means: at most MOST_PIVOTS * SAMPLE vectors come to the driver."""
    sample = vectors.orderBy(F.xxhash64("id")).limit(count * SAMPLE).select("v").toArrow()
    v = unit_rows(sample.column(0).combine_chunks())
    centres = v[:count].copy()
    for _ in range(5):
        nearest = distances(v, centres).argmin(1)
        for k in np.unique(nearest):
            centres[k] = v[nearest == k].mean(0)
    return np.unique(centres, axis=0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def celled(rows: DataFrame, eps: float, block: int = BLOCK, most_pivots: int = MOST_PIVOTS) -> Cells:
    """rows (id, embedding) by home and guest cells. Null vectors are left out."""
    kind = rows.schema["id"].dataType.simpleString()
    number = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # a float is that double, in half the bytes
    vectors = written(rows.where("embedding IS NOT NULL").select("id", F.col("embedding").cast(f"array<{number}>").alias("v")), "near")
    n = vectors.count()
    count = min(most_pivots, -(-n // block))
    if count <= 1:
        return Cells(vectors.select("id", "v", F.lit(0).alias("home"), F.array().cast("array<int>").alias("guest")), [(0, n, 0)] if n else [])
    pivots = pivots_of(vectors, count)
    apart = distances(pivots, pivots)
    radius = np.sqrt(2 * (eps + 1e-6)) + 1e-6  # the exact test rounds to six digits

    def home(batches):
        for b in batches:
            d = distances(unit_rows(b.column(1)), pivots) if len(b) else np.zeros((0, len(pivots)))
            at = d.argmin(1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at])], ["id", "v", "home", "dist"])

    at_home = written(vectors.mapInArrow(home, f"id {kind}, v array<{number}>, home int, dist double"), "near")
    # One row a pivot.
    found = at_home.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in found:
        low[r["home"]], high[r["home"]] = r["low"], r["high"]

    def guests(batches):
        for b in batches:
            d = distances(unit_rows(b.column(1)), pivots) if len(b) else np.zeros((0, len(pivots)))
            at = b.column(2).to_numpy()
            own = d[np.arange(len(at)), at]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d * d - (own * own)[:, None]) / (2 * apart[at])
            may = (plane <= radius) & (d - radius <= high) & (d + radius >= low) & (np.arange(len(pivots)) > at[:, None])
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([np.flatnonzero(x) for x in may], pa.list_(pa.int32()))], ["id", "v", "home", "guest"])

    dealt = written(at_home.mapInArrow(guests, f"id {kind}, v array<{number}>, home int, guest array<int>"), "near")
    visits = dict(dealt.select(F.explode("guest").alias("cell")).groupBy("cell").agg(F.count(F.lit(1))).collect())
    return Cells(dealt, [(r["home"], r["n"], visits.get(r["home"], 0)) for r in found])


def near_pairs(rows: DataFrame, eps: float, forest: bool = False, block: int = BLOCK, most_pivots: int = MOST_PIVOTS, wide: int = WIDE) -> DataFrame:
    """rows (id, embedding): pairs a < b of cosine distance eps or less.

    Each pair of blocks is a matrix product. Every vector goes to all blocks that it meets, so that where most pairs are compared blocks are `wide`. With `forest` it gives a spanning forest of its pairs alone, fewer than its vectors, which has the
    same components. Repeated ids are rows each but no pair with themselves. Null vectors have no pair, vectors of zeros distance 1 to all.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    cells = celled(rows, eps, block, most_pivots)
    if wide > block and len(cells.counts) > 1 and cells.compared * 2 > cells.all_pairs:
        cells, block = celled(rows, eps, wide, most_pivots), wide
    blocks = spark.createDataFrame([(c, -(-n // block), -(-g // block)) for c, n, g in cells.counts], "cell int, own int, others int")
    salt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    none = F.array().cast("array<int>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    here = cells.rows.withColumnRenamed("home", "cell").join(F.broadcast(blocks), "cell").withColumn("at", salt(F.col("own")))
    there = here.select("id", "v", "cell", "at", F.explode(F.transform(F.sequence(F.lit(0), F.col("own") + F.col("others") - 1), lambda x: F.struct(F.least("at", x).alias("lo"), F.greatest("at", x).alias("hi")))).alias("g"))
    visiting = cells.rows.select("id", "v", F.explode("guest").alias("cell")).join(F.broadcast(blocks), "cell").withColumn("at", F.col("own") + salt(F.col("others")))
    visiting = visiting.select("id", "v", "cell", "at", F.explode(F.transform(upto(F.col("own")), lambda x: F.struct(x.alias("lo"), F.col("at").alias("hi")))).alias("g"))
    dealt = there.unionByName(visiting).select("id", "v", "cell", "at", "g.lo", "g.hi")

    def run(group: pa.Table) -> pa.Table:
        ids, at, own = np.array(group.column("id").to_pylist()), group.column("at").to_numpy(), group.schema.field("id").type
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        v = unit_rows(group.column("v").combine_chunks())
        left, right = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        found = []
        for at_row in range(0, len(left), STRIP):
            likeness = v[left[at_row : at_row + STRIP]] @ v[right].T
            a, b = np.nonzero(likeness >= 1 - eps - 1e-5)  # few are left to be rounded
            near = np.round(likeness[a, b], 6) >= 1 - eps
            found.append((a[near] + at_row, b[near]))
        a, b = (np.concatenate([np.zeros(0, int), *c]) for c in (zip(*found) if found else ((), ())))
        x, y = ids[left[a]], ids[right[b]]
        keep = x < y if lo == hi else x != y
        x, y = x[keep], y[keep]
        x, y = np.where(x < y, x, y), np.where(x < y, y, x)
        if forest:
            x, y = spanning(x, y)
        return pa.table([pa.array(x.tolist(), own), pa.array(y.tolist(), own)], ["a", "b"])

    return dealt.groupBy("cell", "lo", "hi").applyInArrow(run, f"a {kind}, b {kind}")


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) that join what earlier ones left apart."""
    root: dict = {}

    def top(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    kept = np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = top(a), top(b)
        if a != b:
            root[b], kept[k] = a, True
    return x[kept], y[kept]
