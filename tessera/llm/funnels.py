"""Operator 11, ordered funnels: how many attempts of each client reach each step, and how long the steps take.

Rows are distinct (client_id, kind, time). Every row of a funnel's first kind starts an attempt; its next step is the client's
earliest later row of the next kind, reached unless it lies over `limit` after the first step or an excluded row lies after
the previous step and not after the next.

* A range window that begins one microsecond after a row gives its next row of every kind, excluded kinds included. It is
  ordered from late to early, so that its frame only grows and every row is added once.
* Windows run over a client's slices of SLICE microseconds, not over clients: as no step lies over `limit` from the first, a slice
  needs its own rows and those up to `limit` after it. One client with a third of all rows is many slices.
* Steps are chained by equi-joins on client, kind and time, a key that is unique on the right. Attempts that ended are in no join,
  so null is no key.
* Percentiles are exact ranks over counts of equal gaps, in two levels: gaps lie within `limit`, cells of sqrt(limit) gaps are
  prefix-summed to find the cell in which the rank falls, then that cell's gaps. No window holds over sqrt(limit) rows, however many attempts.
* Clients of equal depth are counted, and the counts, one row a funnel and depth, are broadcast.

Rows with a null client, kind or time take no part; repeated rows count once; rows of one time are no steps of each other.
Clients without an attempt have no row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Funnel: its kinds in order, and the excluded kind.
FUNNELS = {
    "A": (("view", "click", "view", "purchase"), "error"),
    "B": (("signup", "view", "click", "purchase"), "error"),
    "C": (("click", "click", "purchase", "view"), "signup"),
}
#: Microseconds: of all steps from the first, and of a window's slice (three limits: a third of the rows is in two slices). Percent of the rank.
LIMIT, PERCENT = 300_000_000, 25
SLICE = 3 * LIMIT


def micros(rows: DataFrame, column: str):
    """Microseconds since 1970 of a timestamp; one without a zone is taken as it is written, whatever the session's zone."""
    if rows.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(column)
    clock = (F.hour(column) * 3600 + F.minute(column) * 60).cast("long") * 1_000_000
    return F.unix_date(F.to_date(column)).cast("long") * 86_400_000_000 + clock + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")


def next_rows(rows: DataFrame, kinds: list[str], limit: int = LIMIT) -> DataFrame:
    """rows (client_id, kind, time), distinct: adds `next`, a struct with the time of the client's next row of every kind within the limit, else null."""
    width = 3 * limit
    own = F.floor(F.col("time") / width).cast("long")
    # A row stands in its own slice, and in the one before if that may look ahead to it.
    both = F.when(F.pmod("time", F.lit(width)) <= limit, F.array(own, own - 1)).otherwise(F.array(own))
    dealt = rows.withColumn("slice", F.explode(both))
    later = Window.partitionBy("client_id", "slice").orderBy(F.desc("time")).rangeBetween(Window.unboundedPreceding, -1)
    nearest = {f"_{k}": F.min(F.when(F.col("kind") == kind, F.col("time"))).over(later) for k, kind in enumerate(kinds)}
    near = [F.when(F.col(name) - F.col("time") <= limit, F.col(name)).alias(kind) for name, kind in zip(nearest, kinds)]
    return dealt.withColumns(nearest).where(F.col("slice") == own).select("client_id", "kind", "time", F.struct(*near).alias("next"))


def by_funnel(funnels: dict, value):
    """A column that depends on the row's funnel."""
    out = None
    for name, funnel in funnels.items():
        test = F.col("funnel") == name
        out = F.when(test, value(*funnel)) if out is None else out.when(test, value(*funnel))
    return out


def attempts(rows: DataFrame, funnels: dict = FUNNELS, limit: int = LIMIT) -> list[DataFrame]:
    """rows (client_id, kind, time), distinct: for each step a table (funnel, client_id, first, time, gap) of the attempts that reach it; gap is null at step 1."""
    kinds = sorted({kind for steps, excluded in funnels.values() for kind in (*steps, excluded)})
    linked = written(next_rows(rows, kinds, limit), "funnel-next")

    def reached(step: int):
        """The time of step + 1 from a row of `step` with its `next`, null if the attempt ends."""

        def after(steps, excluded):
            then, bad = F.col("next")[steps[step]], F.col("next")[excluded]
            return F.when((then - F.col("first") <= limit) & (bad.isNull() | (bad > then)), then)

        return by_funnel(funnels, after)

    depth = {len(steps) for steps, _ in funnels.values()}
    if len(depth) > 1:
        raise ValueError("funnels must have equally many steps")
    starts = [F.when(F.col("kind") == steps[0], F.lit(name)) for name, (steps, _) in funnels.items()]
    now = linked.withColumn("funnel", F.explode(F.array_compact(F.array(*starts)))).withColumn("first", F.col("time"))
    out = [now.withColumn("gap", F.lit(None).cast("long"))]
    for step in range(1, depth.pop()):
        then = now.withColumn("_then", reached(step)).where("_then IS NOT NULL")
        then = then.select("funnel", "client_id", "first", F.col("_then").alias("time"), (F.col("_then") - F.col("time")).alias("gap"))
        then = then.withColumn("kind", by_funnel(funnels, lambda steps, _, k=step: F.lit(steps[k])))
        out.append(then)
        wanted = {steps[step] for steps, _ in funnels.values()}
        now = then.join(linked.where(F.col("kind").isin(*wanted)), ["client_id", "kind", "time"])
    return [x.select("funnel", "client_id", "first", "time", "gap") for x in out]


def counted(steps: list[DataFrame], limit: int = LIMIT, percent: int = PERCENT) -> DataFrame:
    """Tables of attempts by step: funnel, client_id, step, n and t, the ceil(percent * n / 100)-th smallest gap."""
    cell = math.isqrt(limit) + 1
    every = None
    for k, x in enumerate(steps):
        one = x.select("funnel", "client_id", F.lit(k + 1).alias("step"), "gap")
        every = one if every is None else every.unionByName(one)
    key = ["funnel", "client_id", "step"]
    gaps = written(every.groupBy(*key, "gap").agg(F.count(F.lit(1)).alias("n")), "funnel-gaps")
    gaps = gaps.withColumn("cell", F.floor(F.col("gap") / cell).cast("int"))

    def rank(of: list[str], by: str):
        """Rows up to and with this one, by counts."""
        return F.sum("n").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))

    cells = gaps.groupBy(*key, "cell").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key))
    cells = cells.withColumns({"upto": rank(key, "cell"), "total": total}).withColumn("rank", F.floor((F.col("total") * percent + 99) / 100).cast("long"))
    cells = cells.where("upto >= rank AND upto - n < rank")
    first = cells.where("cell IS NULL").select(*key, F.col("total").alias("n"), F.lit(None).cast("long").alias("t"))
    at = cells.where("cell IS NOT NULL").select(*key, "cell", "total", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    inside = gaps.join(at, [*key, "cell"]).withColumn("upto", rank([*key, "cell"], "gap"))
    found = inside.where("upto >= rank AND upto - n < rank").select(*key, F.col("total").alias("n"), F.col("gap").alias("t"))
    return first.unionByName(found)


def funnel_counts(rows: DataFrame, funnels: dict = FUNNELS, limit: int = LIMIT, percent: int = PERCENT) -> DataFrame:
    """rows (client_id, kind, arrived_at): funnel, client_id, n1.., deepest, t2.., same_depth."""
    rows = rows.select("client_id", "kind", micros(rows, "arrived_at").alias("time")).dropna().distinct()
    steps = attempts(rows, funnels, limit)
    n = {f"n{k + 1}": F.coalesce(F.max(F.when(F.col("step") == k + 1, F.col("n"))), F.lit(0)) for k in range(len(steps))}
    t = {f"t{k + 1}": F.max(F.when(F.col("step") == k + 1, F.col("t"))) for k in range(1, len(steps))}
    ahead = [*(v.alias(k) for k, v in n.items()), F.max("step").cast("int").alias("deepest"), *(v.alias(k) for k, v in t.items())]
    clients = written(counted(steps, limit, percent).groupBy("funnel", "client_id").agg(*ahead), "funnel-clients")
    # One row a funnel and depth.
    depths = clients.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    return clients.join(F.broadcast(depths), ["funnel", "deepest"]).select("funnel", "client_id", *n, "deepest", *t, "same_depth")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel_counts(table(spark, sf_dir, "clicks"))


def oracle() -> str:
    """The same by as-of joins and sorted lists."""
    parts = []
    for name, (steps, bad) in FUNNELS.items():
        sql = f"SELECT client_id, t AS s1 FROM r WHERE kind = '{steps[0]}'"
        for k in range(1, len(steps)):
            sql = f"""
            SELECT p.*, CASE WHEN n.t - p.s1 <= {LIMIT} AND (x.t IS NULL OR x.t > n.t) THEN n.t END AS s{k + 1}
            FROM ({sql}) p
            ASOF LEFT JOIN (SELECT * FROM r WHERE kind = '{steps[k]}') n ON p.client_id = n.client_id AND p.s{k} < n.t
            ASOF LEFT JOIN (SELECT * FROM r WHERE kind = '{bad}') x ON p.client_id = x.client_id AND p.s{k} < x.t"""
        parts.append(f"SELECT '{name}' AS funnel, * FROM ({sql})")
    count = ", ".join(f"count(s{k}) AS n{k}" for k in (1, 2, 3, 4))
    ranks = ", ".join(f"list_sort(list(s{k} - s{k - 1}) FILTER (s{k} IS NOT NULL))[(count(s{k}) * {PERCENT} + 99) // 100] AS t{k}" for k in (2, 3, 4))
    return f"""
    WITH r AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
    a AS ({" UNION ALL ".join(parts)}),
    c AS (SELECT funnel, client_id, {count}, (1 + (count(s2) > 0)::INT + (count(s3) > 0)::INT + (count(s4) > 0)::INT)::INT AS deepest, {ranks} FROM a GROUP BY funnel, client_id)
    SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM c"""
