"""A knowledge graph derived from the star-schema tables, as DataFrames and as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTS, DOUBLE, PLAIN, SCRIPTS


class Tables:
    """The Parquet tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def order_periods(t: Tables) -> DataFrame:
    """id, custkey, status, start, end (ISO strings): an order is valid from its date, 30 days if filled, 90 if part filled, open else."""
    day = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderstatus") == "F", F.date_add(day, 30)).when(F.col("o_orderstatus") == "P", F.date_add(day, 90))
    return t.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("id"), "o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), "o_orderpriority", day.cast("string").alias("start"), end.cast("string").alias("end"))


PERIODS = """periods AS (
  SELECT 'O' || o_orderkey AS id, o_orderkey, o_custkey AS custkey, o_orderstatus AS status, o_orderpriority, o_orderdate::DATE::VARCHAR AS start,
         CASE o_orderstatus WHEN 'F' THEN (o_orderdate::DATE + 30)::VARCHAR WHEN 'P' THEN (o_orderdate::DATE + 90)::VARCHAR END AS "end" FROM orders)"""


def placed(t: Tables) -> DataFrame:
    """Edges customer to order."""
    return order_periods(t).select(F.concat(F.lit("C"), "custkey").alias("src"), F.col("id").alias("dst"), F.lit("placed").alias("relation"), "start", "end", F.col("o_orderkey").alias("pos"))


def contains(t: Tables) -> DataFrame:
    """Edges order to part, one a line."""
    day = F.to_date("l_shipdate").cast("string")
    return t.lineitem.select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.lit("contains").alias("relation"), day.alias("start"), day.alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


def supplies(t: Tables) -> DataFrame:
    """Edges supplier to part, one a pair, valid from the first to the last shipment."""
    day = F.to_date("l_shipdate")
    rows = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.min(day).cast("string").alias("start"), F.max(day).cast("string").alias("end"))
    return rows.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.lit("supplies").alias("relation"), "start", "end", (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("pos"))


def located(t: Tables) -> DataFrame:
    """Edges supplier to nation and nation to region, without periods."""
    none = F.lit(None).cast("string")
    one = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"), F.lit("located_in").alias("relation"), none.alias("start"), none.alias("end"), F.col("s_suppkey").alias("pos"))
    two = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"), F.lit("part_of").alias("relation"), none.alias("start"), none.alias("end"), F.col("n_nationkey").cast("long").alias("pos"))
    return one.unionByName(two)


EDGES = PERIODS + """, placed AS (SELECT 'C' || custkey AS src, id AS dst, 'placed' AS relation, start, "end", o_orderkey AS pos FROM periods),
contains_ AS (SELECT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst, 'contains' AS relation, l_shipdate::DATE::VARCHAR AS start, l_shipdate::DATE::VARCHAR AS "end", l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
supplies AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, 'supplies' AS relation, min(l_shipdate)::DATE::VARCHAR AS start, max(l_shipdate)::DATE::VARCHAR AS "end", l_suppkey * 10000000 + l_partkey AS pos FROM lineitem GROUP BY l_suppkey, l_partkey),
located AS (SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'located_in' AS relation, NULL::VARCHAR AS start, NULL::VARCHAR AS "end", s_suppkey AS pos FROM supplier
            UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'part_of', NULL, NULL, n_nationkey FROM nation)"""


def places(t: Tables) -> DataFrame:
    """Nodes of nations, regions and suppliers: id, pos, name, type, aliases, description."""
    none = F.lit(None).cast("array<string>")
    row = lambda df, p, k, n, kind, base: df.select(F.concat(F.lit(p), k).alias("id"), (F.col(k).cast("long") + base).alias("pos"), F.col(n).alias("name"), F.array(*map(F.lit, kind)).alias("type"), none.alias("aliases"), F.lit("").alias("description"))
    return row(t.region, "R", "r_regionkey", "r_name", ["Location", "Region"], 0).union(row(t.nation, "N", "n_nationkey", "n_name", ["Location", "Nation"], 1000)).union(row(t.supplier, "S", "s_suppkey", "s_name", ["Organization"], 10_000))


PLACES = """places AS (
  SELECT 'R' || r_regionkey AS id, r_regionkey::BIGINT AS pos, r_name AS name, ['Location', 'Region'] AS type FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_nationkey::BIGINT + 1000, n_name, ['Location', 'Nation'] FROM nation
  UNION ALL SELECT 'S' || s_suppkey, s_suppkey + 10000, s_name, ['Organization'] FROM supplier)"""


def parts(t: Tables) -> DataFrame:
    """Nodes of parts; many share a name, so that they are candidates for alignment."""
    return t.part.select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("type"),
        F.array(F.concat(F.lit("part "), "p_partkey")).alias("aliases"), F.concat(F.lit("size "), "p_size").alias("description"),
    )


PARTS = """parts AS (SELECT 'P' || p_partkey AS id, p_partkey AS pos, p_name AS name, [p_type, p_brand] AS type, ['part ' || p_partkey] AS aliases, 'size ' || p_size AS description FROM part)"""


def timed_texts(t: Tables) -> DataFrame:
    """o_orderkey, text: sentences with ranges, years, dates or none."""
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Orders from "), y, F.lit(" to "), y + 2, F.lit(" and 2003")))
        .when(k == 1, F.concat(F.lit("Placed on "), m, F.lit("/"), d, F.lit("/"), y))
        .when(k == 2, F.concat(F.lit("In "), y, F.lit("-"), y + 1, F.lit(", later "), y + 5))
        .otherwise(F.lit("No time at all"))
    )
    return t.orders.select("o_orderkey", text.alias("text"))


TEXTS = """texts AS (SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN 'Orders from ' || year(o_orderdate) || ' to ' || (year(o_orderdate) + 2) || ' and 2003'
    WHEN 1 THEN 'Placed on ' || month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
    WHEN 2 THEN 'In ' || year(o_orderdate) || '-' || (year(o_orderdate) + 1) || ', later ' || (year(o_orderdate) + 5)
    ELSE 'No time at all' END AS text FROM orders)"""

#: Folding and words of a text, as functions.text has them.
FOLD = f"translate(lower({{0}}), '{ACCENTS}', '{PLAIN}')"
for _letter, _plain in DOUBLE + SCRIPTS:
    FOLD = f"replace({FOLD}, '{_letter}', '{_plain}')"
TOKENS = rf"list_filter(string_split_regex(regexp_replace({FOLD}, '[^\p{{{{L}}}}\p{{{{N}}}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"

#: Time of a period against a year, as functions.temporal.decay.
DECAY = "CASE WHEN nullif({0}, '') IS NULL THEN 0.5::DOUBLE ELSE exp(-power({2} - coalesce((try_cast(substr({0}, 1, 4) AS DOUBLE) + try_cast(substr(coalesce(nullif({1}, ''), {0}), 1, 4) AS DOUBLE)) / 2, 2025), 2) / 50.0::DOUBLE) END"
