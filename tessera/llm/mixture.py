"""Operator 6, mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row gets the key -ln(u) / w: u is uniform, made from a hash of its id, text size and a salt, w
is its quality weight. Ascending keys are a weighted sample without replacement. A source whose
target is t of its s words gives floor(t / s) whole epochs, then rows in key order until the rest
of t is filled; the row that crosses the end is cut to what is missing, or (`whole_rows`) taken if
that comes nearer to the target.

Targets share the whole size by weight; a source is given at most `cap` times its size, and the
excess is shared anew by weight until no source is above. This runs over one row a source.

Prefix sums are made in two levels: rows fall into cells of their key within the source, cells are
summed (on the map side first), cells' sums are prefix-summed, and rows are sorted only in the cell in which
the source's fractional epoch ends. Cells hold about `cell_rows` rows however large a source is, so no task
gets a whole source.

Null texts have size 0 and are taken 0 times. A null source is a source, the last. Tied keys
are ordered by id, then by size; repeated rows count each, and of those that are equal where an epoch ends as many are taken
as fit, in the order of a hash of their columns. An empty table gives an empty result. Reruns agree: nothing depends on the order
or partition of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: FEW: sources that may be broadcast, one row each.
WEIGHTS, CAP, SALT, CELL_ROWS, FEW = (5, 2, 1), 3, "mix", 4096, 20_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text"):
    """Words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text"):
    """A weight of 0.05 to 1 from the text alone: the share of letters (of any script) among its code points, times how
    varied its words are, the logarithm of distinct words over that of all. Repetition and symbols lower it."""
    text = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("double")
    varied = F.try_divide(F.log(F.size(F.array_distinct(words)) + F.lit(1.0)), F.log(F.size(words) + F.lit(1.0)))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, F.length(text).cast("double")) * varied, F.lit(0.05)))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size), one row a source: adds weight and target.

    The sharing is solved exactly and without iteration: a source is capped if its fill rate
    cap * size / weight is below the final rate; sources sorted by that rate are capped in order.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    rated = sizes.withColumn("weight", w).withColumn("rate", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    by_rate = Window.orderBy("rate", F.col("source").asc_nulls_last())
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("rate", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * F.lit(float(cap))).over(before), F.lit(0.0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = rated.withColumn("level", left / share)
    first = F.max(F.when(F.col("rate") >= F.col("level"), F.col("level"))).over(whole)
    # Sources before the first uncapped one are full; all later ones are filled to its level.
    filled = F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce("first_level", "level") * F.col("weight"))
    return level.withColumn("first_level", first).withColumn("target", filled.cast("double")).drop("rate", "level", "first_level")


def _joined(left: DataFrame, right: DataFrame, few: bool = False) -> DataFrame:
    """Left join on source, null equal to null; few: right's rows were counted and may be broadcast."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(right) if few else right, left["source"].eqNullSafe(right["_source"]), "left").drop("_source")


def key_of(weight, salt: str = SALT):
    """-ln(u) / weight, with u from a hash of the row's id and size."""
    digest = F.substring(F.md5(F.concat_ws("/", F.lit(salt), F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, 12)
    return -F.log((F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))) / weight


def cell_of():
    """exp(-key) is within 0 to 1 and falls as the key grows, so that cells are in key order."""
    return F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.col("_cells")).cast("long")


def plan_of(rows: DataFrame, weights=WEIGHTS, cap: float = CAP, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows (doc_id, source, size, _key): one row a source: source_size, target, epochs, missing, and the row at which its fraction ends."""
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    filled = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")) + F.lit(1e-9)).cast("long")
    plan = targets(per_source, weights, cap).withColumn("epochs", F.coalesce(filled, F.lit(0)))
    plan = plan.withColumn("_rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    plan = written(plan.withColumn("_cells", F.greatest(F.lit(1), F.ceil(F.col("_rows") / cell_rows)).cast("long")).drop("_rows", "weight"), "mix-plan")
    few = plan.count() <= FEW
    rows = _joined(rows, plan.select("source", "_rest", "_cells"), few).withColumn("_cell", cell_of())
    cells = rows.groupBy("source", "_cell").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = cells.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    ends = ends.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") >= F.col("_rest")))
    ends = written(ends.select("source", F.col("_cell").alias("_end"), "_before"), "mix-ends")
    inside = _joined(rows, ends, few).where(F.col("_cell") == F.col("_end"))
    # Equal rows are one step of the sum, however many they are.
    inside = inside.groupBy("source", "_cell", "_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
    order = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("size") * F.col("copies")
    inside = inside.withColumn("missing", F.col("_rest") - F.col("_before") - F.coalesce(F.sum(step).over(order), F.lit(0)))
    last = inside.where((F.col("missing") > 0) & (F.col("missing") <= step))
    last = last.groupBy("source").agg(F.min_by(F.struct("_key", "doc_id", "size", "missing", "copies"), F.struct("_key", "doc_id", "size")).alias("_last"))
    return written(_joined(plan, last, few).drop("_rest", "_cells"), "mix-plan")


def mix(docs: DataFrame, rows: DataFrame | None = None, weights=WEIGHTS, cap: float = CAP, cell_rows: int = CELL_ROWS, whole_rows: bool = False) -> DataFrame:
    """docs (doc_id, source, size, _key, and others): adds source_size, target, taken; rows: docs without the others, if they are at hand."""
    plan = plan_of(docs.select("doc_id", "source", "size", "_key") if rows is None else rows, weights, cap, cell_rows)
    facts = plan.agg(F.count(F.lit(1)).alias("n"), F.max("_last.copies").alias("copies")).first()
    out = _joined(docs, plan, facts["n"] <= FEW)
    here, end = F.struct("_key", "doc_id", "size"), F.struct("_last._key", "_last.doc_id", "_last.size")
    ends = F.col("_last").isNotNull() & (here == end)
    size = F.col("size")

    def part(left):
        """What the row that the fraction ends in gives, if `left` words are missing before it."""
        return F.when(left * 2 >= size, size).otherwise(0) if whole_rows else F.greatest(F.lit(0), F.least(left, size))

    before = F.when(F.col("_last").isNotNull() & (here < end), size).otherwise(0)
    taken = lambda fraction: (F.col("epochs") * size + fraction).cast("long")
    if (facts["copies"] or 0) <= 1:
        out = out.withColumn("taken", taken(F.when(ends, part(F.col("_last.missing"))).otherwise(before)))
    else:
        # The few rows that are equal to the last one of a source are numbered; all others need no order.
        known = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        number = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(*known)))
        tied = out.where(ends).withColumn("taken", taken(part(F.col("_last.missing") - (number - 1) * size)))
        out = out.where(~ends).withColumn("taken", taken(before)).unionByName(tied)
    return out.drop("epochs", "_last", "_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of().alias("size"), quality_weight().alias("_weight"))
    out = mix(written(docs.withColumn("_key", key_of(F.col("_weight"))).drop("_weight"), "mix-sizes"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, whole; texts are not shuffled."""
    sized = docs.select("doc_id", "source", size_of().alias("size"), quality_weight().alias("_weight"), F.struct(*docs.columns).alias("_row"))
    own = sized.withColumn("_key", key_of(F.col("_weight"))).drop("_weight")
    rows = written(own.drop("_row"), "mix-sizes")
    out = mix(own, rows, whole_rows=True)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return out.withColumn("_times", times).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def oracle() -> str:
    """The contract's words in SQL: shares by weight, excess shared anew until no source is above, one sum over each source's rows."""
    return rf"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, len(w)::BIGINT AS size,
             greatest(0.05::DOUBLE, coalesce(length(regexp_replace(t, '\P{{L}}+', '', 'g'))::DOUBLE / nullif(length(t), 0) * (ln(len(list_distinct(w)) + 1.0::DOUBLE) / nullif(ln(len(w) + 1.0::DOUBLE), 0)), 0.05::DOUBLE)) AS weight
      FROM (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS share FROM d GROUP BY source
    ), r(k, source, source_size, share, full_) AS (
      SELECT 0, source, source_size, share, false FROM s
      UNION ALL
      SELECT k + 1, source, source_size, share, full_ OR level * share >= 3.0::DOUBLE * source_size
      FROM (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN full_ THEN 3.0::DOUBLE * source_size ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN full_ THEN 0 ELSE share END) OVER (), 0) AS level FROM r)
      WHERE k < (SELECT count(*) FROM s)
    ), t AS (
      SELECT source, source_size, CASE WHEN full_ THEN 3.0::DOUBLE * source_size ELSE level * share END AS target
      FROM (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN full_ THEN 3.0::DOUBLE * source_size ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN full_ THEN 0 ELSE share END) OVER (), 0) AS level FROM r WHERE k = (SELECT count(*) FROM s))
    ), k AS (
      SELECT d.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0) + 1e-9), 0)::BIGINT AS epochs,
             -ln((('0x' || substr(md5('mix/' || doc_id || '/' || size), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / weight AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), p AS (
      SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM k
    )
    SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, greatest(0, round(target)::BIGINT - epochs * source_size) - prior)))::BIGINT AS taken FROM p"""
