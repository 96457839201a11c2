"""Operator 3, URL filter: explicit rules first, else an empirical-Bayes reputation of the host.

Labelled outcomes of pages (good or not) are counted by host; the counts are shrunk through
beta-binomial priors: the suffix's mean is drawn to the whole table's, the registered domain's to
its suffix's, the host's to its domain's. Each level's prior strength is fitted to the table by the
method of moments. A page is allowed where the lower posterior bound of its host reaches `floor`.

Counts are aggregated before any join (partial sums on the map side, so a host with a third of all
pages is one counter per task); pages meet host bounds in one left join on host.

The suffix is a host's last label, or its last two where a general second level stands below a country (as co.uk); the registered
domain is one label more. User names and ports are no part of them; numeric addresses are their own domain, under one suffix.

Null urls, or urls without `://`: empty host and path, judged by the table's own mean. Repeated
pages stay repeated. An empty table gives an empty result. A url's labels are found by the number in
its path, which is the id of the document that the page shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table, written

#: The rules of the query: action, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
FLOOR, Z = 0.5, 1.64

HOST = r"^(?s:.*?)://([^/?#]*)"
PATH = r"^(?s:.*?)://[^/?#]*([^?#]*)"


def rule_cases(rules=RULES) -> tuple[str, str]:
    """SQL CASE expressions over host and path: the longest rule that fits, and its action."""
    name, action = "CASE", "CASE"
    for what, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        test = f"WHEN (host = '{host}' OR right(host, {len(host) + 1}) = '.{host}') AND left(path, {len(path)}) = '{path}'"
        name += f" {test} THEN '{host}{path}'"
        action += f" {test} THEN '{what}'"
    return f"{name} END", f"{action} END"


def parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(url, PATH, 1)})


#: General second levels below two-letter countries, fixed values.
SECOND = "ac|co|com|edu|gen|go|gob|gouv|gov|govt|gv|id|ind|lg|ltd|me|mil|ne|net|nhs|nic|nom|or|org|plc|police|sch"
BARE = "regexp_extract(host, '^(?:[^@]*@)?([^:]*?)[.]*(?::.*)?$', 1)"
ADDRESS = f"(host LIKE '[%' OR {BARE} RLIKE '^[0-9]+([.][0-9]+)+$')"
SUFFIX = f"CASE WHEN {ADDRESS} THEN 'address' ELSE regexp_extract({BARE}, '(?:^|[.])((?:(?:{SECOND})[.])?[a-z][a-z]|[^.]+)$', 1) END"
#: Of a host with its suffix.
DOMAIN = f"CASE WHEN {ADDRESS} THEN host WHEN {BARE} = suffix THEN suffix ELSE concat(regexp_extract(left({BARE}, length({BARE}) - length(suffix) - 1), '[^.]*$', 0), '.', suffix) END"


def num(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def strength(level: str) -> str:
    """SQL: the prior strength of one level of counts, by moments of the beta-binomial; within 1 to 1000."""
    return f"""
      SELECT CASE WHEN k < 2 OR d <= 0 OR mu <= 0 OR mu >= 1 THEN {num(1000)}
             ELSE greatest({num(1)}, least({num(1000)}, d / greatest(ss / (mu * (1 - mu)) - (k - 1), {num('1e-9')}) - 1)) END AS kappa
      FROM (SELECT max(mu) AS mu, CAST(count(*) AS DOUBLE) AS k, sum(n * power(s / n - mu, 2)) AS ss,
                   sum(n) - sum(n * n) / nullif(sum(n), 0) - (count(*) - 1) AS d
            FROM (SELECT *, (SELECT mu FROM g) AS mu FROM {level} WHERE n > 0))"""


def reputation_sql(outcomes: str = "outcomes", z: float = Z) -> str:
    """SQL: host, bound of all hosts in `outcomes` (host, n, s)."""
    return f"""
    WITH y AS (SELECT host, {SUFFIX} AS suffix, CAST(n AS DOUBLE) AS n, CAST(s AS DOUBLE) AS s FROM {outcomes}),
    h AS (SELECT host, {DOMAIN} AS domain, suffix, n, s FROM y),
    g AS (SELECT coalesce(sum(s) / nullif(sum(n), 0), {num(0.5)}) AS mu FROM h),
    d AS (SELECT domain, max(suffix) AS suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY domain),
    x AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM d GROUP BY suffix),
    kh AS ({strength("h")}), kd AS ({strength("d")}), kx AS ({strength("x")}),
    mx AS (SELECT suffix, (kappa * mu + s) / (kappa + n) AS m
           FROM (SELECT *, (SELECT mu FROM g) AS mu, (SELECT kappa FROM kx) AS kappa FROM x)),
    md AS (SELECT domain, (kappa * m + s) / (kappa + n) AS m
           FROM (SELECT *, (SELECT kappa FROM kd) AS kappa FROM d JOIN mx USING (suffix))),
    ab AS (SELECT host, kappa * m + s AS a, kappa * (1 - m) + n - s AS b
           FROM (SELECT host, n, s, m, (SELECT kappa FROM kh) AS kappa FROM h JOIN md USING (domain)))
    SELECT host, a / (a + b) - {num(z)} * sqrt(a * b / (power(a + b, 2) * (a + b + 1))) AS bound FROM ab"""


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR, z: float = Z) -> DataFrame:
    """pages with host and path, outcomes (host, n, s) of every host of pages: adds rule, bound, verdict."""
    spark = pages.sparkSession
    bounds = spark.sql(reputation_sql("{outcomes}", z), outcomes=outcomes)
    name, action = rule_cases(rules)
    fallback = F.when(F.col("bound") >= floor, "allow").otherwise("block")
    out = pages.join(bounds, "host", "left")
    return out.withColumns({"rule": F.expr(name), "verdict": F.coalesce(F.expr(action), fallback)})


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by host: n labelled pages, s good ones (quality 1, not toxic). Hosts without labels count 0."""
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")
    )
    doc = F.expr("try_cast(nullif(regexp_extract(path, '^/[^/]+/([0-9]{1,18})', 1), '') AS BIGINT)")
    # Pages without a number take no part in the join: null is no key that they could all fall to.
    known = pages.select("host", doc.alias("doc_id")).where("doc_id IS NOT NULL").join(told, "doc_id").select("host", F.lit(1).alias("n"), F.col("good").alias("s"))
    every = pages.select("host", F.lit(0).alias("n"), F.lit(0).alias("s"))
    return known.union(every).groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = parts(table(spark, sf_dir, "pages").select("page_id", "url"))
    outcomes = written(outcomes_of(pages, table(spark, sf_dir, "labels")), "outcomes")
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The rules and the method in SQL of its own: rules as rows, levels as rows of one table, moments from lists."""
    rules = ", ".join(f"('{what}', '{host}', '{path}')" for what, host, path in RULES)

    def kappa(level: str) -> str:
        return f"""
        SELECT CASE WHEN k < 2 OR room <= 0 OR mean IN (0, 1) OR mean IS NULL THEN 1000.0::DOUBLE
                    ELSE greatest(1.0::DOUBLE, least(1000.0::DOUBLE, room / greatest(spread / (mean * (1 - mean)) - (k - 1), 1e-9::DOUBLE) - 1)) END
        FROM (SELECT len(l) AS k, m AS mean, list_sum([x.n * ((x.s / x.n - m) ** 2) for x in l]) AS spread,
                     list_sum([x.n for x in l]) - list_sum([x.n * x.n for x in l]) / list_sum([x.n for x in l]) - (len(l) - 1) AS room
              FROM (SELECT list({{'n': n, 's': s}}) AS l, (SELECT mean FROM overall) AS m FROM {level} WHERE n > 0))"""

    return f"""
    WITH p AS (
      SELECT page_id, CASE WHEN sep > 0 THEN translate(split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
             CASE WHEN sep > 0 THEN split_part(split_part(substr(rest, length(split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1)) + 1), '?', 1), '#', 1) ELSE '' END AS path
      FROM (SELECT page_id, strpos(coalesce(url, ''), '://') AS sep, substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3) AS rest FROM pages)
    ), rules(action, rule_host, rule_path) AS (VALUES {rules}),
    fits AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
             FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
    good AS (SELECT doc_id, bool_and(quality IS NOT DISTINCT FROM 1 AND coalesce(toxic, 0) = 0)::INT AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    told AS (SELECT host, good FROM (SELECT host, try_cast(regexp_extract(split_part(path, '/', 3), '^[0-9]{{1,18}}') AS BIGINT) AS doc_id FROM p WHERE starts_with(path, '/') AND NOT starts_with(path, '//')) JOIN good USING (doc_id)),
    hosts AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS s FROM (SELECT DISTINCT host FROM p) LEFT JOIN told USING (host) GROUP BY host),
    labelled AS (SELECT *, string_split(host, '.') AS l FROM hosts),
    suffixed AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 'address' WHEN len(l) > 1 AND length(l[-1]) = 2 AND l[-2] IN ({", ".join(f"'{x}'" for x in SECOND.split("|"))}) THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix FROM labelled),
    h AS (SELECT host, n, s, suffix, CASE WHEN suffix = 'address' OR host = suffix THEN host ELSE list_extract(string_split(left(host, length(host) - length(suffix) - 1), '.'), -1) || '.' || suffix END AS domain FROM suffixed),
    overall AS (SELECT coalesce(sum(s) / nullif(sum(n), 0), 0.5::DOUBLE) AS mean FROM h),
    d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY domain),
    x AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM d GROUP BY suffix),
    k AS (SELECT coalesce(({kappa("h")}), 1000) AS kh, coalesce(({kappa("d")}), 1000) AS kd, coalesce(({kappa("x")}), 1000) AS kx),
    mx AS (SELECT suffix, (kx * mean + s) / (kx + n) AS m FROM x, k, overall),
    md AS (SELECT domain, (kd * m + d.s) / (kd + d.n) AS m FROM d JOIN mx USING (suffix), k),
    ab AS (SELECT host, kh * m + s AS a, kh * (1 - m) + n - s AS b FROM h JOIN md USING (domain), k),
    bounds AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM ab)
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bound >= {FLOOR} THEN 'allow' ELSE 'block' END) AS verdict
    FROM p JOIN bounds USING (host) LEFT JOIN fits USING (host, path)"""
