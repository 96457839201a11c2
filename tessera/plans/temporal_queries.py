"""Queries of the temporal operators, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal as T
from ..functions.text import intent
from ..operators import build, graph
from ..operators.intervals import overlapping
from . import kg
from .registry import query

Q = "CASE WHEN {c} THEN 1 ELSE 0 END"


@query("temporal_overlap_filter", f"""WITH {kg.PERIODS} SELECT id, start, "end" FROM periods WHERE start <= '1998-06-30' AND coalesce("end", '9999-12-31') >= '1998-01-01'""")
def overlap_filter(t):
    return kg.order_periods(t).where(T.overlaps("start", "end", F.lit("1998-01-01"), F.lit("1998-06-30"))).select("id", "start", "end")


QUESTIONS = [(1, "1998-01-01", "1998-12-31"), (2, "1900-01-01", "1900-12-31"), (3, "2000", None)]
QUESTIONS_SQL = "questions(question_id, q_start, q_end) AS (VALUES (1, '1998-01-01', '1998-12-31'), (2, '1900-01-01', '1900-12-31'), (3, '2000', NULL))"


def asked(t):
    return t.spark.createDataFrame(QUESTIONS, "question_id int, q_start string, q_end string")


VALID = """p.start <= coalesce(CASE WHEN length(q_end) = 4 THEN q_end || '-01-01' ELSE q_end END, CASE WHEN length(q_start) = 4 THEN q_start || '-01-01' ELSE q_start END)
  AND CASE WHEN length(q_start) = 4 THEN q_start || '-01-01' ELSE q_start END <= coalesce(p."end", '9999-12-31')"""


def asked_orders(t):
    rows = kg.order_periods(t).withColumn("_q", F.explode(F.array(*[F.struct(F.lit(a).alias("question_id"), F.lit(b).cast("string").alias("q_start"), F.lit(c).cast("string").alias("q_end")) for a, b, c in QUESTIONS])))
    return rows.select("id", "start", "end", "_q.*")


@query("temporal_filter_with_fallback", f"""WITH {kg.PERIODS}, {QUESTIONS_SQL},
  v AS (SELECT question_id, id, ({VALID}) AS ok FROM periods p CROSS JOIN questions), s AS (SELECT *, max(ok::INT) OVER (PARTITION BY question_id) AS any_ok FROM v)
  SELECT question_id, id FROM s WHERE ok OR any_ok = 0""")
def filter_with_fallback(t):
    return graph.time_filter(asked_orders(t), ["question_id"], "start", "end", F.col("q_start"), F.col("q_end")).select("question_id", "id")


@query("passage_time_filter_strict_off", f"""WITH {kg.PERIODS}, {QUESTIONS_SQL} SELECT question_id, id FROM periods CROSS JOIN questions""")
def filter_not_strict(t):
    return graph.time_filter(asked_orders(t), ["question_id"], "start", "end", F.col("q_start"), F.col("q_end"), strict=False).select("question_id", "id")


@query("passage_time_filter_strict", f"""WITH {kg.PERIODS}, {QUESTIONS_SQL},
  v AS (SELECT question_id, 'D' || o_orderkey AS passage, ({VALID}) AS ok FROM periods p CROSS JOIN questions WHERE status <> 'O'), s AS (SELECT *, max(ok::INT) OVER (PARTITION BY question_id) AS any_ok FROM v)
  SELECT question_id, passage FROM s WHERE ok OR any_ok = 0""")
def filter_passages(t):
    """Passages by their own time; the question that none fits keeps all."""
    rows = asked_orders(t).join(kg.order_periods(t).where("status <> 'O'").select("id", F.concat(F.lit("D"), "o_orderkey").alias("passage")), "id")
    return graph.time_filter(rows, ["question_id"], "start", "end", F.col("q_start"), F.col("q_end")).select("question_id", "passage")


@query("nodes_to_remove", f"""WITH {kg.PERIODS}, {QUESTIONS_SQL}, v AS (SELECT question_id, id, ({VALID}) AS ok FROM periods p CROSS JOIN questions WHERE question_id = 1)
  SELECT question_id, id FROM v WHERE NOT ok""")
def nodes_to_remove(t):
    rows = asked_orders(t).where("question_id = 1")
    kept = graph.time_filter(rows, ["question_id"], "start", "end", F.col("q_start"), F.col("q_end"))
    return rows.select("question_id", "id").join(kept.select("question_id", "id"), ["question_id", "id"], "left_anti")


@query("temporal_decay_score", f"""WITH {kg.PERIODS} SELECT id, round({kg.DECAY.format('start', '"end"', '1998')}, 9) AS score FROM periods""")
def decay_score(t):
    return kg.order_periods(t).select("id", F.round(T.decay("start", "end", F.lit(1998.0)), 9).alias("score"))


@query("temporal_boost_weight", f"""WITH {kg.PERIODS} SELECT status, CASE WHEN start <= '1998-12-31' AND coalesce("end", '9999-12-31') >= '1998-01-01' THEN 3.0 ELSE 1.0 END::DOUBLE AS weight, count(*) AS n FROM periods GROUP BY ALL""")
def boost_weight(t):
    rows = kg.order_periods(t).withColumn("weight", T.boost("start", "end", F.lit("1998-01-01"), F.lit("1998-12-31")))
    return rows.groupBy("status", "weight").agg(F.count(F.lit(1)).alias("n"))


RANGES = r"'(?i)\b(\d{4})\s*(?:to|-)\s*(\d{4})\b'"
RANGES_ALL = f"regexp_extract_all(text, {RANGES}"


@query("extract_year_ranges", f"""WITH {kg.TEXTS}, r AS (SELECT o_orderkey, unnest({RANGES_ALL}, 1)) AS a, unnest({RANGES_ALL}, 2)) AS b FROM texts) SELECT o_orderkey, a || '-01-01' AS start, b || '-12-31' AS "end" FROM r""")
def extract_year_ranges(t):
    return kg.timed_texts(t).select("o_orderkey", F.explode(T.year_ranges("text")).alias("r")).select("o_orderkey", "r.start", "r.end")


YEARS = rf"regexp_extract_all(regexp_replace(text, {RANGES}, '~', 'g'), '\b(1\d{{3}}|2\d{{3}})\b', 1)"


@query("extract_years", f"""WITH {kg.TEXTS} SELECT o_orderkey, unnest({YEARS}) AS year FROM texts""")
def extract_years(t):
    return kg.timed_texts(t).select("o_orderkey", F.explode(T.single_years("text")).alias("year"))


DATES = r"regexp_extract_all(text, '\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b', 1)"
MDY = "strptime({0}, '%m/%d/%Y')::DATE"


@query("extract_dates", f"""WITH {kg.TEXTS}, d AS (SELECT o_orderkey, unnest({DATES}) AS x FROM texts) SELECT o_orderkey, ({MDY.format('x')})::VARCHAR AS day FROM d""")
def extract_dates(t):
    return kg.timed_texts(t).select("o_orderkey", F.explode(T.dates("text")).alias("day")).withColumn("day", F.col("day").cast("string"))


@query("query_interval_resolution", f"""WITH {kg.TEXTS}, p AS (SELECT o_orderkey, {RANGES_ALL}, 1)[1] AS a, {RANGES_ALL}, 2)[1] AS b, {YEARS}[1] AS y, {DATES}[1] AS d FROM texts)
  SELECT o_orderkey, coalesce(a || '-01-01', y || '-01-01', ({MDY.format('d')})::VARCHAR, '2025-01-01') AS start, coalesce(b || '-12-31', y || '-12-31', ({MDY.format('d')})::VARCHAR, '2025-12-31') AS "end" FROM p""")
def query_interval_resolution(t):
    return kg.timed_texts(t).select("o_orderkey", T.query_interval("text").alias("i")).select("o_orderkey", "i.start", "i.end")


STAMPS = "CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate)::VARCHAR WHEN 1 THEN strftime(o_orderdate, '%Y/%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


def stamps(t):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 0, F.year(d).cast("string")).when(k == 1, F.date_format(d, "yyyy/MM")).when(k == 2, F.date_format(d, "yyyy-MM")).when(k == 3, F.lit("")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", text.alias("stamp"))


@query("expand_timestamp", f"""WITH s AS (SELECT o_orderkey, replace(nullif({STAMPS}, ''), '/', '-') AS x FROM orders)
  SELECT o_orderkey, CASE length(x) WHEN 4 THEN x || '-01-01' WHEN 7 THEN x || '-01' ELSE x END AS start, CASE length(x) WHEN 4 THEN x || '-12-31' WHEN 7 THEN last_day((x || '-01')::DATE)::VARCHAR ELSE x END AS "end" FROM s""")
def expand_timestamp(t):
    return stamps(t).select("o_orderkey", T.expand("stamp").alias("i")).select("o_orderkey", "i.start", "i.end")


@query("normalise_expression_confidence", f"""WITH {kg.TEXTS}, k AS (SELECT CASE WHEN len({RANGES_ALL}, 1)) > 0 THEN 'range' WHEN len({YEARS}) > 0 THEN 'year' WHEN len({DATES}) > 0 THEN 'date' ELSE 'other' END AS kind FROM texts)
  SELECT kind, CASE kind WHEN 'range' THEN 0.9 WHEN 'other' THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence, count(*) AS n FROM k GROUP BY ALL""")
def normalise_confidence(t):
    kind = F.when(F.size(T.year_ranges("text")) > 0, "range").when(F.size(T.single_years("text")) > 0, "year").when(F.size(T.dates("text")) > 0, "date").otherwise("other")
    return kg.timed_texts(t).select(kind.alias("kind")).withColumn("confidence", T.confidence("kind")).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("validate_query_time", f"""WITH {kg.PERIODS}, c AS (SELECT c_custkey, list_sort(list(DISTINCT start) FILTER (start IS NOT NULL)) AS times FROM customer LEFT JOIN periods ON custkey = c_custkey GROUP BY c_custkey),
  k AS (SELECT c_custkey, coalesce(len(times), 0) AS n, len(list_filter(coalesce(times, []), lambda x: x <= '1996-06-01')) AS kept FROM c)
  SELECT c_custkey, n > 0 AND kept > 0 AS valid, CASE WHEN n = 0 THEN 'no_temporal_data' WHEN kept = 0 THEN 'before_all_contexts' END AS reason, kept::BIGINT AS kept FROM k""")
def validate_query_time(t):
    times = kg.order_periods(t).groupBy("custkey").agg(F.array_sort(F.collect_set("start")).alias("times"))
    rows = t.customer.select("c_custkey").join(times, F.col("c_custkey") == F.col("custkey"), "left")
    return rows.select("c_custkey", T.validated("times", F.lit("1996-06-01")).alias("v")).select("c_custkey", "v.valid", "v.reason", F.size("v.kept").cast("long").alias("kept"))


@query("context_times", f"""WITH {kg.PERIODS} SELECT DISTINCT coalesce("end", start) AS context_time FROM periods""")
def context_times(t):
    return kg.order_periods(t).select(F.coalesce("end", "start").alias("context_time")).distinct()


@query("passage_primary_time", """SELECT l_orderkey AS passage, first(l_shipdate::DATE::VARCHAR ORDER BY l_linenumber, l_shipdate) AS start FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey""")
def passage_primary_time(t):
    start = F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate").cast("string"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("passage"), F.struct("l_linenumber", "l_shipdate").alias("pos"), start.alias("start"), F.lit(None).cast("string").alias("end"))
    return build.first_period(rows, "passage", "pos").select("passage", "start")


@query("inherit_time", f"""WITH {kg.PERIODS} SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate::DATE::VARCHAR END, start) AS start FROM lineitem LEFT JOIN periods ON l_orderkey = o_orderkey""")
def inherit_time(t):
    own = F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate").cast("string"))
    rows = t.lineitem.join(kg.order_periods(t).select("o_orderkey", "start"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(own, "start").alias("start"))


@query("parse_lenient_date", f"""WITH s AS (SELECT o_orderkey, {STAMPS} AS x FROM orders) SELECT o_orderkey, CASE WHEN length(x) = 4 THEN x || '-01-01' WHEN length(x) = 10 THEN x END AS day,
  coalesce(CASE WHEN length(x) = 4 THEN x || '-01-01' WHEN length(x) = 10 THEN x END, '1900-01-01') AS stamp FROM s""")
def parse_lenient_date(t):
    return stamps(t).select("o_orderkey", T.parse_lenient("stamp").cast("string").alias("day"), T.parse_timestamp("stamp").cast("string").alias("stamp"))


FORMS = ["d MMMM yyyy", "dd MMM yyyy", "MMMM d, yyyy", "MMM. dd yyyy", "yyyy/MM/dd", "yyyy.M.d", "MM/dd/yyyy", "M-d-yy", "EEEE, d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss", "'the' d'th of' MMMM yyyy", "dd-MMM-yyyy"]


@query("date_forms", """SELECT o_orderkey, CASE WHEN k < 12 THEN o_orderdate::DATE WHEN k = 12 THEN date_trunc('month', o_orderdate)::DATE WHEN k = 13 THEN o_orderdate::DATE - 1 WHEN k = 14 THEN o_orderdate::DATE - 21
  WHEN k = 15 THEN (o_orderdate::DATE - INTERVAL 1 YEAR)::DATE END::VARCHAR AS day FROM (SELECT *, o_orderkey % 18 AS k FROM orders)""")
def date_forms(t):
    """Orders' dates written in words and numbers, and relative to themselves."""
    k, d = F.col("o_orderkey") % 18, F.col("o_orderdate")
    text = F.when(k == 12, F.date_format(d, "MMMM yyyy")).when(k == 13, F.lit("Yesterday")).when(k == 14, F.lit("3 weeks ago")).when(k == 15, F.lit("last year")).when(k == 16, F.lit("32 March 2019")).otherwise(F.lit("Mayhem 3, 2019"))
    for n, form in enumerate(FORMS):
        text = F.when(k == n, F.date_format(d, form)).otherwise(text)
    rows = t.orders.select("o_orderkey", F.to_date(d).alias("today"), text.alias("x"))
    return rows.select("o_orderkey", T.parse_lenient("x", "today").cast("string").alias("day"))


PERIOD_QUESTIONS = [(k, f"{1995 + k}-03-01", f"{1995 + k}-04-15") for k in range(6)]


@query("interval_join_questions", f"""WITH {kg.PERIODS}, q(question_id, q_start, q_end) AS (VALUES {", ".join(map(str, PERIOD_QUESTIONS))})
  SELECT question_id, count(*) AS n, min(id) AS first FROM periods JOIN q ON start <= q_end AND q_start <= coalesce("end", '9999-12-31') GROUP BY question_id""")
def interval_join_questions(t):
    q = t.spark.createDataFrame(PERIOD_QUESTIONS, "question_id int, q_start string, q_end string").withColumns({c: F.col(c).cast("date") for c in ("q_start", "q_end")})
    rows = kg.order_periods(t).select("id", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    return overlapping(q, rows).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


#: A question for each of the first thousand customers; every 50th has no end, every 70th no start.
MANY = """q AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 70 <> 0 THEN DATE '1992-01-01' + (c_custkey * 37 % 2600)::INT END AS q_start,
  CASE WHEN c_custkey % 50 <> 0 THEN DATE '1992-01-01' + (c_custkey * 37 % 2600 + c_custkey % 90)::INT END AS q_end FROM customer WHERE c_custkey <= 1000)"""
OPEN_PERIODS = kg.PERIODS + """, open_ AS (SELECT id, CASE WHEN o_orderkey % 1000 <> 0 THEN start::DATE END AS start, "end"::DATE AS "end" FROM periods)"""


@query("interval_join_open", f"""WITH {OPEN_PERIODS}, {MANY}, p AS (SELECT question_id, id, start FROM open_ JOIN q ON start IS NULL OR (start <= coalesce(q_end, q_start) AND q_start <= coalesce("end", DATE '9999-12-31')))
  SELECT question_id, count(*) AS n, count(*) FILTER (start IS NULL) AS always, min(id) AS first, max(id) AS last FROM p GROUP BY question_id""")
def interval_join_open(t):
    """A thousand questions against all orders' periods: without starts, without ends, questions without either."""
    k, zero = F.col("c_custkey"), F.lit("1992-01-01").cast("date")
    shift = (k * 37 % 2600).cast("int")
    q = t.customer.where("c_custkey <= 1000").select(k.alias("question_id"), F.when(k % 70 != 0, F.date_add(zero, shift)).alias("q_start"), F.when(k % 50 != 0, F.date_add(zero, shift + (k % 90).cast("int"))).alias("q_end"))
    rows = kg.order_periods(t).select("id", F.when(F.col("o_orderkey") % 1000 != 0, F.col("start").cast("date")).alias("start"), F.col("end").cast("date").alias("end"))
    found = overlapping(q, rows)
    return found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start").isNull()).alias("always"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("intent_rules", f"""WITH {kg.TEXTS}, q AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Which came first: ' WHEN 1 THEN 'During the war: ' ELSE '' END || text AS x FROM texts), l AS (SELECT lower(x) AS x FROM q)
  SELECT CASE WHEN regexp_matches(x, '\\b(first|last|before|after|earlier|later|earliest|latest|prior to)\\b') THEN 'ordering' WHEN regexp_matches(x, '\\b[12]\\d{{3}}\\b|\\b\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}\\b') THEN 'explicit_temporal'
    WHEN regexp_matches(x, '\\b(during|when|while|since|until)\\b') THEN 'implicit_temporal' ELSE 'atemporal' END AS intent, count(*) AS n FROM l GROUP BY ALL""")
def intent_rules(t):
    head = F.when(F.col("o_orderkey") % 3 == 0, "Which came first: ").when(F.col("o_orderkey") % 3 == 1, "During the war: ").otherwise("")
    return kg.timed_texts(t).select(intent(F.concat(head, "text")).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
