"""From documents and extracted facts to the three layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.temporal import validity
from ..functions.text import repaired_json, sentences
from ..sources.stages import written


def extracted(rows: DataFrame, column: str = "response") -> DataFrame:
    """Adds `entity_layer`, parsed from a model's text; null where it is no object with nodes."""
    parsed = rows.withColumn("entity_layer", F.from_json(repaired_json(column), S.EXTRACTION))
    return parsed.withColumn("entity_layer", F.when(F.col("entity_layer.nodes").isNotNull(), F.col("entity_layer")))


def bad_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("entity_layer").isNull())


def repaired(rows: DataFrame, again: DataFrame, key: str = "doc") -> DataFrame:
    """Good rows, and for the bad ones their second try where there is one."""
    good = rows.where(F.col("entity_layer").isNotNull())
    second = again.join(bad_rows(rows).select(key), key, "left_semi")
    rest = bad_rows(rows).join(second.select(key), key, "left_anti")
    return good.unionByName(second.select(rows.columns)).unionByName(rest)


def single_pass(docs: DataFrame, aliases: bool = False, split=sentences) -> S.Graph:
    """docs (doc string, pos, text, entity_layer): passages, sentences, nodes and edges with times, one pass, deterministic ids.

    Nodes and edges without a time take their passage's, which is that of its first timed node. Edges with an unknown
    end are dropped. A sentence is linked to the nodes whose names (with `aliases`, or aliases) occur in it. `split` cuts a text column into an array of sentences.
    """
    none = F.array().cast("array<string>")
    docs = docs.where((F.length("text") > 0) & F.col("entity_layer").isNotNull()).select("doc", "pos", "text", "entity_layer")
    docs = written(docs, "extracted").select("doc", "pos", "text", "entity_layer.*")  # answers are parsed once for the four tables
    interval = lambda t: F.when(t.isNotNull(), F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(1.0).alias("confidence")))
    extracted_by = F.create_map(F.lit("llm_extracted"), F.lit("true"))
    # All of it is local to a document's row: ids, times and edge ends come from its arrays, without any exchange.
    period = lambda x: validity(x["valid_time"]["start"], x["valid_time"]["end"])
    docs = docs.withColumn("_own", F.transform("nodes", period))
    docs = docs.withColumn("_first", F.try_element_at(F.filter("_own", lambda t: t.isNotNull()), F.lit(1)))
    docs = docs.withColumn("_ids", F.transform("nodes", lambda n, k: F.struct(n["id"].alias("local"), n["name"].alias("name"), F.concat_ws(":", F.lit("node"), "doc", k).alias("id"))))
    raw = docs.select("doc", "_first", "_own", F.posexplode("nodes").alias("k", "n"))
    own = F.try_element_at("_own", F.col("k") + 1)
    node_rows = raw.select(
        F.concat_ws(":", F.lit("node"), "doc", "k").alias("id"), "n.name", "n.type", "n.description", "n.aliases", extracted_by.alias("properties"),
        interval(F.coalesce(own, F.col("_first"))).alias("valid_time"), "n.is_temporal_entity",
    )

    def end(column: str):
        """The last node of the document that has the local id."""
        return F.try_element_at(F.filter("_ids", lambda i: i["local"] == F.col(column)), F.lit(-1))["id"]

    links = docs.select("doc", "_first", "_ids", F.posexplode("edges").alias("k", "e"))
    links = links.withColumns({"_s": F.col("e.source_node_id"), "_t": F.col("e.target_node_id")}).withColumns({"source_node_id": end("_s"), "target_node_id": end("_t")})
    edge_rows = links.where("source_node_id IS NOT NULL AND target_node_id IS NOT NULL").select(
        F.concat_ws(":", F.lit("edge"), "doc", "k").alias("edge_id"), "source_node_id", "target_node_id", F.col("e.relationship_name").alias("relationship_name"), extracted_by.alias("properties"),
        interval(F.coalesce(period(F.col("e")), F.col("_first"))).alias("valid_time"), F.lit(None).cast("string").alias("temporal_relation"),
    )
    cut = docs.withColumn("_s", split("text"))
    passages = cut.select(
        F.concat_ws(":", F.lit("passage"), "doc").alias("passage_id"), "text", F.coalesce(F.transform("_ids", lambda i: i["id"]), none).alias("node_map"),
        F.transform("_s", lambda s, k: F.concat_ws(":", F.lit("sent"), "doc", k)).alias("sentence_map"),
        interval(F.col("_first")).alias("primary_time"), F.array().cast(f"array<{S.EXPRESSION}>").alias("temporal_expressions"),
    )
    cut = cut.withColumn("_ids", F.transform("nodes", lambda n, k: F.struct(n["id"].alias("local"), n["name"].alias("name"), n["aliases"].alias("aliases"), F.concat_ws(":", F.lit("node"), "doc", k).alias("id"))))
    inside = cut.select("doc", "_ids", F.posexplode("_s").alias("k", "text")).withColumn("_low", F.lower("text"))
    called = lambda n: F.concat(F.array(n["name"]), F.coalesce(n["aliases"], none)) if aliases else F.array(n["name"])
    sentence_rows = inside.select(
        F.concat_ws(":", F.lit("sent"), "doc", "k").alias("sentence_id"), F.concat_ws(":", F.lit("passage"), "doc").alias("passage_id"), "text",
        F.transform(F.filter("_ids", lambda n: F.exists(called(n), lambda x: (x != "") & F.col("_low").contains(F.lower(x)))), lambda n: n["id"]).alias("node_map"),
        F.array().cast(f"array<{S.EXPRESSION}>").alias("temporal_expressions"),
    )
    return S.Graph(node_rows, edge_rows, passages, sentence_rows)


def first_period(rows: DataFrame, key: str, position: str) -> DataFrame:
    """rows (key, position, start, end): each key's first period with a start."""
    return rows.where(F.nullif(F.trim("start"), F.lit("")).isNotNull()).groupBy(key).agg(F.min_by(F.struct("start", "end"), position).alias("_p")).select(key, "_p.start", "_p.end")


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def zipped(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Rows with what was computed for them elsewhere, by an explicit key; rows without a result stay."""
    return rows.join(results, key, "left")
