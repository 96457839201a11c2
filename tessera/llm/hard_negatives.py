"""Operator 12, hard negatives by a two-dimensional block matrix multiply.

Anchors are rows, too; a row's score with an anchor is the integer inner product of their vectors. An anchor's positives are its
`positives` best other rows (of another id) of the same label; the negatives of a positive are the best `negatives` rows of another label whose
score lies between two shares of the positive's. Higher scores come first, ties by smaller id.

* Rows are dealt into blocks of about ROWS rows, anchors into blocks of about ANCHORS, and dimensions into `chunks`. Block a of anchors meets block b of
  rows at (a, b, chunk): a task multiplies two such panels to a partial tile of int64 (sent in the narrowest type that holds it).
* Partial tiles are shuffled by (a, b) and added. A task holds one pair of blocks, never a whole row of tiles.
* The sum's best per anchor, or per anchor and positive, leave the tile; windows over these few find the best of all tiles. Spark's
  group limit cuts them once more before they are shuffled.
* Labels are hashed to at most PARTS parts and blocks are cut within parts, so that positives need the tiles of an anchor's own part
  alone. A label with a third of all rows is many blocks. Negatives take one pass over all tiles, with the positives' scores at hand.

The product is that of all anchors and all rows, so that work grows with both; anchors are a stated query set.

Rows with a null id, label or vector, or with a null component take no part, nor do those with components that are not finite, if vectors are
scaled by `whole`. Rows that are equal in all three count once; rows of one id that differ are rows each, as are anchors. Vectors
of unequal lengths are filled up with zeros. Sums wrap beyond 64 bits. Anchors without positives, and positives without negatives, have no row. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows and anchors a block, chunks of the dimensions, and parts of labels at most (one row of counts each goes to the driver).
ROWS, ANCHORS, CHUNKS, PARTS = 4096, 256, 2, 4096
SCALE, ANCHOR_EVERY, MOVE_EVERY = 256, 50, 7
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


def whole(vector, scale: float = SCALE):
    """Components as floor(scale * x), x as double; null if the vector is null or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """Integers in the narrowest type that holds them."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return kind, x.astype(kind).tobytes()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in int64; by doubles where these are exact."""
    size = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if size < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


PANEL = "part int, block int, chunk int, ids binary, labels binary, kind string, width int, panel binary"


def panels(rows: DataFrame, chunks: int) -> DataFrame:
    """rows (part, block, vec_id, label, vector, width): a row for each block and chunk of dimensions, in order of id; ids and labels go with chunk 0."""

    def pack(key, found):
        ids, labels = (found.column(c).to_numpy() for c in ("vec_id", "label"))
        vectors = found.column("vector").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        wide = np.zeros((len(ids), int(found.column("width")[0].as_py())), np.int64)
        wide[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
        order = np.lexsort((labels, ids))
        if ((np.diff(ids[order]) == 0) & (np.diff(labels[order]) == 0)).any():
            order = np.lexsort((*wide.T[::-1], labels, ids))
        out = []
        for k, part in enumerate(np.array_split(wide[order], chunks, axis=1)):
            kind, blob = narrow(part)
            out.append((key[0].as_py(), key[1].as_py(), k, ids[order].tobytes() if not k else None, labels[order].astype(np.int64).tobytes() if not k else None, kind, part.shape[1], blob))
        kinds = (*[pa.int32()] * 3, pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in PANEL.split(", ")])

    return rows.groupBy("part", "block").applyInArrow(pack, PANEL)


TILE = "a int, b int, chunk int, a_ids binary, a_labels binary, wants binary, b_ids binary, b_labels binary, kind string, tile binary"


def tiles(anchors: DataFrame, rows: DataFrame, best, schema: str) -> DataFrame:
    """Panels of anchors (with from_b, to_b, and `wants` for the sum) and of rows (with from_a, to_a): what `best` finds in each summed tile.

    best(a, a_ids, a_labels, wants, b, b_ids, b_labels, tile) gives columns of `schema`.
    """
    names = [x.split()[0] for x in TILE.split(", ")]
    left = anchors.withColumnRenamed("block", "a").withColumn("b", F.explode(F.expr("sequence(from_b, to_b)"))).drop("from_b", "to_b", "part")
    right = rows.withColumnRenamed("block", "b").withColumn("a", F.explode(F.expr("sequence(from_a, to_a)"))).drop("from_a", "to_a", "part")

    def multiply(key, one, two):
        # Blocks may have got no row, and chunks beyond the vectors' width add nothing.
        if not len(one) or not len(two) or not one.column("width")[0].as_py():
            return pa.table([pa.array([], k) for k in kinds], names)
        (x,), (y,) = one.to_pylist(), two.to_pylist()
        p, q = (np.frombuffer(z["panel"], z["kind"]).astype(np.int64).reshape(-1, z["width"]) for z in (x, y))
        kind, blob = narrow(product(p, q))
        values = (x["a"], x["b"], x["chunk"], x["ids"], x["labels"], x["wants"], y["ids"], y["labels"], kind, blob)
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def add(key, found):
        parts = found.to_pylist()
        head = next(x for x in parts if x["a_ids"] is not None)
        ids = {c: np.frombuffer(head[c], np.int64) for c in ("a_ids", "a_labels", "b_ids", "b_labels")}
        total = np.zeros(len(ids["a_ids"]) * len(ids["b_ids"]), np.int64)
        for x in parts:
            total += np.frombuffer(x["tile"], x["kind"])
        return best(head["a"], ids["a_ids"], ids["a_labels"], head["wants"], head["b"], ids["b_ids"], ids["b_labels"], total.reshape(len(ids["a_ids"]), -1))

    kinds = (*[pa.int32()] * 3, *[pa.binary()] * 5, pa.string(), pa.binary())
    partial = left.groupBy("a", "b", "chunk").cogroup(right.groupBy("a", "b", "chunk")).applyInArrow(multiply, TILE)
    return partial.groupBy("a", "b").applyInArrow(add, schema)


NEAR = "a int, slot int, anchor_id bigint, b int, positive_id bigint, score bigint"
FAR = "a int, slot int, place int, anchor_id bigint, positive_id bigint, positive_score bigint, b int, negative_id bigint, score bigint"
#: What an anchor block is told of its positives.
WANT = np.dtype([("slot", "<i4"), ("place", "<i4"), ("id", "<i8"), ("score", "<i8")])


def _columns(schema: str, values) -> pa.Table:
    types = {"int": pa.int32(), "bigint": pa.int64()}
    return pa.table([pa.array(v, types[x.split()[1]]) for v, x in zip(values, schema.split(", "))], [x.split()[0] for x in schema.split(", ")])


def nearest(count: int):
    """The `count` best rows of the anchor's label and another id, of a tile."""

    def best(a, a_ids, a_labels, _, b, b_ids, b_labels, tile):
        mask = (a_labels[:, None] == b_labels) & (a_ids[:, None] != b_ids)
        slots, cols = np.nonzero(mask)
        scores = tile[slots, cols]
        # Columns are in order of id, and the sort is stable.
        order = np.lexsort((-scores, slots))
        slots, cols, scores = slots[order], cols[order], scores[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        slots, cols, scores = (x[place < count] for x in (slots, cols, scores))
        return _columns(NEAR, (np.full(len(slots), a, np.int32), slots.astype(np.int32), a_ids[slots], np.full(len(slots), b, np.int32), b_ids[cols], scores))

    return best


def within(count: int, low: int, high: int):
    """The `count` best rows of another label whose score lies between low and high percent of a positive's, of a tile."""

    def best(a, a_ids, a_labels, wants, b, b_ids, b_labels, tile):
        wants = np.frombuffer(wants or b"", WANT)
        out = []
        # Percent of a score by integers of any size: bounds of whole scores.
        floor, ceiling = ([f(int(s)) for s in wants["score"]] for f in (lambda s: -(-low * s // 100), lambda s: high * s // 100))
        for k, want in enumerate(wants):
            scores = tile[want["slot"]]
            cols = np.flatnonzero((scores >= floor[k]) & (scores <= ceiling[k]) & (b_labels != a_labels[want["slot"]]))
            if len(cols) > 8 * count:
                least = np.partition(scores[cols], -count)[-count]
                cols = cols[scores[cols] >= least]
            cols = cols[np.argsort(-scores[cols], kind="stable")[:count]]
            out += [(a, want["slot"], want["place"], a_ids[want["slot"]], want["id"], want["score"], b, b_ids[c], scores[c]) for c in cols]
        return _columns(FAR, list(zip(*out)) or [[]] * 9)

    return best


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, rows_a_block: int = ROWS, anchors_a_block: int = ANCHORS, chunks: int = CHUNKS) -> DataFrame:
    """rows (vec_id bigint, label, vector array of bigint, anchor boolean): anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", F.col("label").cast("bigint").alias("label"), "vector", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = rows.where(F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"))
    rows = written(rows.groupBy("vec_id", "label", "vector").agg(F.max("anchor").alias("anchor")), "negatives-rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width, parts = max(1, facts["width"] or 0), max(1, min(PARTS, -(-facts["n"] // rows_a_block)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int"))
    # At most PARTS rows: the blocks of each part.
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).orderBy("part").collect()
    plan, first_a, first_b = [], 0, 0
    for s in sizes:
        own_a, own_b = -(-s["anchors"] // anchors_a_block), -(-s["n"] // rows_a_block)
        plan.append((s["part"], first_a, own_a, first_b, own_b))
        first_a, first_b = first_a + own_a, first_b + own_b
    plan = spark.createDataFrame(plan, "part int, first_a int, own_a int, first_b int, own_b int")
    deal = lambda first, own, salt: (F.col(first) + F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.col(own))).cast("int")
    dealt = rows.withColumn("width", F.lit(width)).join(F.broadcast(plan), "part")
    columns = ["part", "block", "vec_id", "label", "vector", "width"]
    b = written(panels(dealt.withColumn("block", deal("first_b", "own_b", 1)).select(*columns), chunks), "negatives-rows")
    a = written(panels(dealt.where("anchor").withColumn("block", deal("first_a", "own_a", 2)).select(*columns), chunks), "negatives-anchors")

    # Positives: tiles within parts.
    none = F.lit(None).cast("binary").alias("wants")
    own_a = a.join(F.broadcast(plan), "part").select(*a.columns, none, F.col("first_b").alias("from_b"), F.expr("first_b + own_b - 1 AS to_b"))
    own_b = b.join(F.broadcast(plan), "part").where("own_a > 0").select(*b.columns, F.col("first_a").alias("from_a"), F.expr("first_a + own_a - 1 AS to_a"))
    near = tiles(own_a, own_b, nearest(positives), NEAR)
    order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "positive_id", "b")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # At most `positives` entries an anchor, so that a block's list is bounded as the block is.
    wants = near.groupBy("a").agg(F.collect_list(F.struct("slot", "place", "positive_id", "score")).alias("list"))

    def told(batches):
        for batch in batches:
            lists = [np.array([(w["slot"], w["place"], w["positive_id"], w["score"]) for w in x], WANT).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(lists, pa.binary())], ["block", "wants"])

    wants = written(wants.mapInArrow(told, "block int, wants binary"), "negatives-positives")

    # Negatives: all tiles of the anchors that have positives. Their list travels with chunk 0.
    heads = a.join(wants, "block").withColumn("wants", F.when(F.col("chunk") == 0, F.col("wants")))
    every_a = heads.select(*a.columns, "wants", F.lit(0).alias("from_b"), F.lit(first_b - 1).alias("to_b"))
    every_b = b.where(F.lit(first_a > 0)).select(*b.columns, F.lit(0).alias("from_a"), F.lit(max(0, first_a - 1)).alias("to_a"))
    far = tiles(every_a, every_b, within(negatives, low, high), FAR)
    order = Window.partitionBy("a", "slot", "place").orderBy(F.desc("score"), "negative_id", "b")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % MOVE_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), whole(F.col("embedding")).alias("vector"), (F.col("vec_id") % ANCHOR_EVERY == 0).alias("anchor")))


def oracle() -> str:
    """All anchors against all rows, by numbered rows."""
    return f"""
    WITH v AS (
      SELECT DISTINCT vec_id, CASE WHEN vec_id % {MOVE_EVERY} = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.e, r.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v r ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> r.vec_id
    ), p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
    )
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
    QUALIFY rank <= {NEGATIVES}"""
