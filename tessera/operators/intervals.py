"""Periods that overlap, joined by equal keys: periods as nodes of a tree over days.

Days are numbered from 0001-01-01 and lie at the leaves of a tree in which a node has 4 children: LEVELS levels hold all dates. A period
is cut into the few largest nodes that make it up (its cover), a day lies below one node of each level (its ancestors). Two periods overlap if the
second begins within the first, or the first begins within the second after the second's begin. Either is an equi-join of one's cover with the other's
ancestors, and as a cover's nodes are apart, no pair is met twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, LAST = "0001-01-01", "9999-12-31"
#: Levels of the tree, 2 bits of a day's number each: 4 ** 11 days are over 11,000 years.
LEVELS, BITS = 11, 2
#: Questions that are sent to all tasks.
FEW = 20_000


def day(text: str | Column) -> Column:
    """A date as its number from 0001-01-01."""
    return F.datediff(F.col(text) if isinstance(text, str) else text, F.lit(FIRST).cast("date"))


def node(level, place) -> Column:
    """A node's key: its level, and which of that level it is."""
    return F.shiftleft(place.cast("long"), 8) + level


def ancestors(at: Column, levels: list[int]) -> Column:
    """The nodes above a day, of the levels named."""
    return F.array(*[node(F.lit(k), F.shiftright(at, BITS * k)) for k in levels])


def cover(low: Column, high: Column) -> Column:
    """The largest nodes that make up the days from low to high; none if low is after high.

    On level k whole nodes lie from ceil(low / 4^k) to floor((high + 1) / 4^k); of these stay those at either end that do not fill a parent.
    """
    parts, none = [], F.array().cast("array<bigint>")
    first = lambda k: F.shiftright(low + ((1 << BITS * k) - 1), BITS * k)
    behind = lambda k: F.shiftright(high + 1, BITS * k)
    at = lambda k: lambda i: node(F.lit(k), i)
    for k in range(LEVELS):
        parents = (first(k + 1) <= behind(k + 1)) if k < LEVELS - 1 else F.lit(False)
        up = F.when(parents, F.shiftleft(first(k + 1), BITS)).otherwise(behind(k))
        down = F.when(parents, F.shiftleft(behind(k + 1), BITS)).otherwise(behind(k))
        for x, y in ((first(k), up), (down, behind(k))):
            parts.append(F.when(x < y, F.transform(F.sequence(x, y - 1), at(k))).otherwise(none))
    return F.concat(*parts)


def overlapping_pairs(left: DataFrame, right: DataFrame, left_days: tuple[str, str], right_days: tuple[str, str]) -> DataFrame:
    """Rows of left and right (whose columns have other names) whose periods, pairs of day numbers without nulls, share a day.

    Periods that end before they begin meet those that hold both days. Every pair is kept once; equal rows make pairs each. The right is counted: if it
    is small it goes to the left's tasks, else both are shuffled. The left, whose nodes are many times its file's size, is never broadcast.
    """
    (a, b), (c, d) = left_days, right_days
    # Which levels the right's covers have: a few numbers, so that the left's days climb to those alone.
    levels = right.agg(F.sort_array(F.collect_set(F.floor(F.log2(F.greatest(F.col(d) - F.col(c) + 1, F.lit(1))) / BITS).cast("int")))).first()[0] or []
    high = max(levels, default=0)
    beside = F.broadcast if right.count() <= FEW else lambda df: df.hint("merge")
    exact = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b))
    one = left.withColumn("_node", F.explode(cover(F.col(a), F.col(b)))).join(beside(right.withColumn("_node", F.explode(ancestors(F.col(c), list(range(LEVELS)))))), "_node").where(exact)
    later = right.withColumn("_node", F.explode(cover(F.col(c) + 1, F.col(d))))
    two = left.withColumn("_node", F.explode(ancestors(F.col(a), list(range(min(high, LEVELS - 1) + 1))))).join(beside(later), "_node").where(exact)
    return one.unionByName(two).drop("_node")


def overlapping(questions: DataFrame, rows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows (with dates start, end) whose period overlaps a question's (q_start, q_end).

    A row without a start is always valid, without an end it is open; a question without an end is its start's day. Questions without a start meet
    rows without a start alone.
    """
    first, last = (F.lit(x).cast("date") for x in (FIRST, LAST))
    begins, asked = F.col(start), F.col("q_start")
    # Rows travel as structs, so that names of their columns cannot clash with those of the join.
    timed = rows.select(F.struct("*").alias("_row"), day(F.coalesce(begins, first)).alias("_a"), day(F.when(begins.isNull(), last).otherwise(F.coalesce(F.col(end), last))).alias("_b"))
    known = questions.where(asked.isNotNull()).select(F.struct("*").alias("_asked"), day(asked).alias("_c"), day(F.coalesce("q_end", "q_start")).alias("_d"))
    out = overlapping_pairs(timed, known, ("_a", "_b"), ("_c", "_d"))
    always = rows.where(begins.isNull()).select(F.struct("*").alias("_row"), F.lit(0).alias("_k"))
    unknown = questions.where(asked.isNull()).select(F.struct("*").alias("_asked"), F.lit(0).alias("_k"))
    unknown = F.broadcast(unknown) if unknown.count() <= FEW else unknown.hint("merge")
    return out.select("_row.*", "_asked.*").unionByName(always.join(unknown, "_k").select("_row.*", "_asked.*"))
