"""Ranks and their fusion. Every rank table is (question_id, item, rnk); ties are broken by named columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MISSING_RANK
from ..sources.stages import written

#: Wanted places that are sent to all tasks, more are sorted among the rows; rows that a task sorts at a time.
FEW, CHUNK = 500_000, 200_000


def rank_by(rows: DataFrame, score: Column | str, item: str = "item", name: str = "rnk", digits: int = 12) -> DataFrame:
    """ROW_NUMBER by falling score, ties by item."""
    score = F.col(score) if isinstance(score, str) else score
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round(score, digits)), item)
    return rows.withColumn(name, F.row_number().over(order))


def rrf_sum(rankings: list[DataFrame], k: int = 0) -> DataFrame:
    """Sum of 1 / (k + rank) over the rankings that hold an item; ties by the first ranking, then item."""
    rows = [r.select("question_id", "item", F.lit(n).alias("_n"), "rnk") for n, r in enumerate(rankings)]
    both = reduce(DataFrame.unionByName, rows)
    first = F.min(F.when(F.col("_n") == 0, F.col("rnk")))
    out = both.groupBy("question_id", "item").agg(F.sum(1.0 / (k + F.col("rnk"))).alias("score"), F.coalesce(first, F.lit(MISSING_RANK)).alias("_first"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), "_first", "item")
    return out.withColumn("rnk", F.row_number().over(order)).drop("_first")


def rrf_join(items: DataFrame, rankings: dict[str, tuple[DataFrame, Column | float]], k: int = 10) -> DataFrame:
    """items (question_id, item, ...) scored by weight / (k + rank) of each named ranking; a missing rank is MISSING_RANK."""
    out, score = items, F.lit(0.0)
    for name, (ranking, weight) in rankings.items():
        out = out.join(ranking.select("question_id", "item", F.col("rnk").alias(f"rank_{name}")), ["question_id", "item"], "left")
        out = out.withColumn(f"rank_{name}", F.coalesce(f"rank_{name}", F.lit(MISSING_RANK)))
        score = score + (F.lit(weight) if isinstance(weight, float) else weight) / (k + F.col(f"rank_{name}"))
    return out.withColumn("score", score)


def top_overlap(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """question_id, jaccard of the k best items of two rankings."""
    best = lambda r, name: r.where(F.col("rnk") <= k).groupBy("question_id").agg(F.collect_set("item").alias(name))
    both = best(first, "_a").join(best(second, "_b"), "question_id", "full")
    a, b = F.coalesce("_a", F.array().cast("array<string>")), F.coalesce("_b", F.array().cast("array<string>"))
    union = F.size(F.array_union(a, b))
    return both.select("question_id", F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0).alias("jaccard"))


def time_weight(weight, jaccard, limit: float = 0.5, factor: float = 0.5) -> Column:
    """The time ranking's weight, less where it says what the graph's ranking says anyway."""
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return F.when(F.col(jaccard) > limit, weight * factor).otherwise(weight)


def semantic_edge_rank(pairs: DataFrame, keep: str = "worst") -> DataFrame:
    """pairs (question_id, lo, hi, rnk) of ranked triplets: one rank a pair of nodes in either orientation."""
    low, high = F.least("lo", "hi"), F.greatest("lo", "hi")
    return pairs.groupBy("question_id", low.alias("lo"), high.alias("hi")).agg((F.max if keep == "worst" else F.min)("rnk").alias("rnk"))


def oriented_edge_rank(triplets: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked triplets (question_id, src, dst, rnk) that are edges (question_id, src, dst) in that orientation: ranks among these alone.

    An edge that several triplets have gets the first's rank; the others keep their places, so that ranks have gaps.
    """
    kept = triplets.join(edges.select("question_id", "src", "dst").distinct(), ["question_id", "src", "dst"], "left_semi")
    order = Window.partitionBy("question_id").orderBy("rnk", "src", "dst")
    return kept.withColumn("_r", F.row_number().over(order)).groupBy("question_id", "src", "dst").agg(F.min("_r").alias("rnk"))


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Items of the first ranking, then those of the second that are not in it, ranked anew."""
    both = first.select("question_id", "item", F.lit(0).alias("_p"), "rnk").unionByName(second.select("question_id", "item", F.lit(1).alias("_p"), "rnk"))
    once = both.groupBy("question_id", "item").agg(F.min(F.struct("_p", "rnk")).alias("_o"))
    order = Window.partitionBy("question_id").orderBy("_o", "item")
    return once.withColumn("rnk", F.row_number().over(order)).drop("_o")


def first_rows(k: int, asked, value, *ties):
    """Of arrays (question's number, value, ties) the first k rows of each question, in order."""
    import numpy as np

    codes = [np.unique(x, return_inverse=True)[1] for x in ties]
    order = np.lexsort((*codes[::-1], value, asked))
    a = asked[order]
    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
    order = order[np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a)))) < k]
    return asked[order], value[order], *[x[order] for x in ties]


def in_order(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """rows with their number, from 1, in the order given: ranges are counted and numbered within, so that no task has all rows."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbers")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + at + 1).drop("_part", "_at", "_n", "_before")


def places(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (question_id, key), wanted (question_id, key), keys structs of values without nulls: wanted, once each, with `before`, the question's rows of lesser key.

    Up to FEW wanted keys (counted) are sent to all tasks: rows are neither shuffled nor sorted as a whole, a task sorts CHUNK of them at a time among the wanted keys, and only
    counts leave it. More wanted keys are sorted among the rows in ranges, and nothing of either passes the driver.
    """
    wanted = wanted.select("question_id", "key").distinct()
    return _places_in_ranges(rows, wanted) if wanted.count() > FEW else _places(rows, wanted)


def _places_in_ranges(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for any number of wanted keys: a range counts its questions' rows as it reads them in order; ranges before it add their totals."""
    import numpy as np
    import pyarrow as pa

    names = rows.schema["key"].dataType.names
    flat = lambda df, row: df.select("question_id", *[F.col("key")[c].alias(f"_k{n}") for n, c in enumerate(names)], F.lit(row).alias("_row"))
    both = flat(wanted, 0).unionByName(flat(rows, 1))
    order = both.columns
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches):
        question, n, totals, part, kinds = None, 0, [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            kinds, part = b.schema, b.column("_part")[0].as_py()
            q, row = b.column("question_id").to_numpy(zero_copy_only=False), b.column("_row").to_numpy().astype(np.int64)
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            length, upto = np.diff(np.append(first, len(q))), np.cumsum(row)
            count = upto - np.repeat(upto[first] - row[first], length)
            if question is not None and q[0] == question:
                count[: length[0]] += n
            elif question is not None:
                totals.append((question, n))
            totals += [(q[k], count[k]) for k in first[1:] - 1]
            question, n = q[-1], count[-1]
            kept = pa.array(row == 0)
            wanted_rows = b.filter(kept)
            yield pa.record_batch([*wanted_rows.columns, pa.array(count).filter(kept)], [*b.schema.names, "_n"])
        if question is not None:
            totals.append((question, n))
            # A range's totals are marked by a row of 2.
            size = len(totals)
            head = pa.array(np.array([t[0] for t in totals]).tolist(), kinds.field("question_id").type)
            blank = [pa.nulls(size, f.type) for f in kinds if f.name.startswith("_k")]
            yield pa.record_batch([head, *blank, pa.array([2] * size, pa.int32()), pa.array([part] * size, pa.int32()), pa.array([int(t[1]) for t in totals], pa.int64())], [*kinds.names, "_n"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    told = written(ranged.mapInArrow(run, f"{kinds}, _n bigint"), "places")
    earlier = Window.partitionBy("question_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = told.where("_row = 2").select("question_id", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = told.where("_row = 0").join(before, ["question_id", "_part"])
    return out.select("question_id", F.struct(*[F.col(f"_k{n}").alias(c) for n, c in enumerate(names)]).alias("key"), (F.col("_n") + F.col("_before")).alias("before"))


def _places(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for wanted keys that one task can hold."""
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession
    names = rows.schema["key"].dataType.names
    flat = lambda df: df.select("question_id", *[F.col("key")[c].alias(c) for c in names])
    table = flat(wanted).toArrow()
    keys = spark.sparkContext.broadcast(table)

    def below(chunk: list) -> pa.RecordBatch:
        """Of each wanted key the chunk's rows below it."""
        codes, size = [], keys.value.num_rows
        found = pa.Table.from_batches(chunk)
        for a, b in zip(keys.value.columns, found.columns):
            codes.append(np.unique(np.concatenate([a.to_numpy(), b.to_numpy()]), return_inverse=True)[1])
        is_row = np.repeat([0, 1], [size, found.num_rows])
        order = np.lexsort((is_row, *codes[:0:-1], codes[0]))
        upto, question = np.cumsum(is_row[order]), codes[0][order]
        first = np.flatnonzero(np.append(True, question[1:] != question[:-1]))
        base = np.repeat(upto[first] - is_row[order][first], np.diff(np.append(first, len(order))))
        own = np.flatnonzero(order < size)
        n = (upto - base)[own]
        return pa.record_batch([pa.array(order[own][n > 0], pa.int32()), pa.array(n[n > 0], pa.int64())], ["_w", "_n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                yield below(held)
                held, size = [], 0
        if size and keys.value.num_rows:
            yield below(held)

    totals = flat(rows).mapInArrow(run, "_w int, _n bigint").groupBy("_w").agg(F.sum("_n").alias("_n"))
    listed = spark.createDataFrame(table.append_column("_w", pa.array(np.arange(table.num_rows), pa.int32())))
    out = listed.join(totals, "_w", "left")
    return out.select("question_id", F.struct(*[F.col(c) for c in names]).alias("key"), F.coalesce("_n", F.lit(0)).alias("before"))


@dataclass(frozen=True)
class Ranking:
    """A ranking that need not be made whole: its first k rows a question, and the ranks of wanted items (question_id, item)."""

    top: Callable[[int], DataFrame]
    ranks: Callable[[DataFrame], DataFrame]


def rrf_top(rankings: list[Ranking], limit: int, k: int = 0) -> DataFrame:
    """The first `limit` rows of `rrf_sum` over whole rankings, from their first rows and a few more ranks.

    An item that is in no ranking's first `reach` rows scores at most n / (k + reach + 1), and so less than each of the first `limit` of any one ranking.
    Ranks beyond the reach are looked up for the items that are within it elsewhere.
    """
    reach = len(rankings) * (k + limit) - k
    tops = [written(r.top(reach).select("question_id", "item", "rnk"), "first-ranks") for r in rankings]
    items = reduce(DataFrame.union, [x.select("question_id", "item") for x in tops]).distinct()
    out, score = items, F.lit(0.0)
    for n, (ranking, first) in enumerate(zip(rankings, tops)):
        missing = ranking.ranks(items.join(first, ["question_id", "item"], "left_anti"))
        every = first.unionByName(missing.select("question_id", "item", F.col("rnk").cast("int").alias("rnk")))
        out = out.join(every.withColumnRenamed("rnk", f"_r{n}"), ["question_id", "item"], "left")
        score = score + F.coalesce(1.0 / (k + F.col(f"_r{n}")), F.lit(0.0))
    out = out.select("question_id", "item", score.alias("score"), F.coalesce("_r0", F.lit(MISSING_RANK)).alias("_first"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), "_first", "item")
    return out.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit).drop("_first")
