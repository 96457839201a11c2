"""The staged build: extraction, alignment and embedding as stage tables; a later run resumes at the first missing one.

A stage is taken as it is only if it was made from the same input: documents that were added make its table anew. With a ledger their texts alone go to the model.

`python -m tessera.plans.staged --stage all --documents docs.json --out folder` runs it; models are given by `--model module:function`.
"""

from __future__ import annotations

import argparse
import importlib
import logging
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entity_description
from ..operators import build, dense, plugins, resolve
from ..operators.plugins import Model
from ..sources import files, stages
from ..sources.stages import fingerprint

STAGES = ("er", "debug_er", "align", "embed", "all")
log = logging.getLogger("tessera")


def extract(spark: SparkSession, docs: DataFrame, out: str, model: Model, **how) -> DataFrame:
    """Stage er: docs (doc, pos, text) with their entity layers, and the calls' token counts beside them."""
    key = fingerprint(docs)
    rows = stages.stage(spark, f"{out}/extraction", lambda: build.extracted(plugins.extraction(docs, model, **how)), key)
    stages.stage(spark, f"{out}/usage", lambda: plugins.usage(rows), key)
    return rows


def repair(spark: SparkSession, out: str, model: Model, **how) -> DataFrame:
    """Stage debug_er: rows without an entity layer are asked for again; the others stay."""
    rows = spark.read.parquet(f"{out}/extraction")

    def again() -> DataFrame:
        bad = build.bad_rows(rows).select("doc", "pos", "text")
        return build.repaired(rows, build.extracted(plugins.extraction(bad, model, **how)))

    return stages.stage(spark, f"{out}/repaired", again, fingerprint(rows))


def align(spark: SparkSession, rows: DataFrame, out: str, embedder: Callable | None = None, model: Model | None = None, eps: float = 0.5, most: int = 100) -> dict[str, DataFrame]:
    """Stage align: combined graph, exact alignment, merging and completion of similar entities, links of sentences to entities; each a stage table, numbered anew.

    Without an embedder nothing is similar; without a model clusters whose nodes share all types are one.
    """
    rows = rows.select("doc", "pos", "text", "entity_layer")
    stage = partial(stages.stage, inputs=fingerprint(rows))
    graph = build.single_pass(rows, aliases=True)

    def numbered(name: str, nodes: Callable[[], DataFrame], edges: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Two stage tables whose ids are 1..n in the order of positions."""
        raw = stage(spark, f"{out}/{name}-raw", nodes)
        names = stage(spark, f"{out}/{name}-ids", lambda: resolve.reset_ids(raw.select("id", "pos"), ["pos", "id"]).select("id", "new_id"))
        end = lambda c: names.toDF(c, f"_{c}")
        fresh = lambda: raw.join(names, "id").withColumn("id", F.col("new_id")).drop("new_id")
        wired = lambda: edges().join(end("src"), "src").join(end("dst"), "dst").withColumns({"src": F.col("_src"), "dst": F.col("_dst")}).drop("_src", "_dst")
        return stage(spark, f"{out}/{name}-nodes", fresh), stage(spark, f"{out}/{name}-edges", wired)

    # An id ends in its number; the document's own id before it may hold colons, too.
    part = lambda k: F.regexp_extract("id", "(?s)^node:(.*):([0-9]+)$", k)
    place = F.struct(part(1).alias("doc"), part(2).cast("long").alias("k"))
    first_edges = graph.edges.select(F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), F.col("relationship_name").alias("relation"), F.col("edge_id").alias("pos"), "valid_time")
    nodes, edges = numbered("original", lambda: graph.nodes.withColumn("pos", place), lambda: resolve.first_edges(first_edges.where("src <> dst")))
    links = stage(spark, f"{out}/original-links", lambda: graph.sentences.select(F.col("sentence_id").alias("text_id"), F.explode("node_map").alias("id")).join(spark.read.parquet(f"{out}/original-ids"), "id").select("text_id", F.col("new_id").alias("id")))

    def merged(name: str, before: tuple[DataFrame, DataFrame], make: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
        nonlocal links
        mapping = stage(spark, f"{out}/{name}-mapping", make)
        after = numbered(name, lambda: resolve.merge_nodes(before[0], mapping), lambda: resolve.rewired(before[1], mapping))
        old = links
        base = lambda: old.join(mapping, old["id"] == mapping["member"], "left").select("text_id", F.coalesce("base", "id").alias("id"))
        links = stage(spark, f"{out}/{name}-links", lambda: base().join(spark.read.parquet(f"{out}/{name}-ids"), "id").select("text_id", F.col("new_id").alias("id")).distinct())
        return after

    nodes, edges = merged("exact", (nodes, edges), lambda: resolve.align_exact(nodes))
    if embedder is not None:
        before = nodes
        vectors = stage(spark, f"{out}/vectors", lambda: plugins.embed(before.select("id", entity_description("type", "name").alias("text")), embedder))
        near = stage(spark, f"{out}/near", lambda: resolve.near_pairs(vectors.select("id", "embedding"), eps))

        def clusters() -> DataFrame:
            found = resolve.components(near).withColumnsRenamed({"node": "id", "component": "cluster"})
            seen = found.join(resolve.blank_descriptions(before), "id")
            rows_ = seen.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("members"), F.collect_list("name").alias("names"), F.collect_set(F.array_sort("type")).alias("_types"), F.to_json(F.collect_list(F.struct("id", "name", "type", "aliases"))).alias("entities"))
            return resolve.cluster_gates(rows_)

        def judged() -> DataFrame:
            told = resolve.merge_by_rule(clusters(), F.size("_types") == 1) if model is None else plugins.judged_clusters(clusters(), model)
            groups = resolve.instruction_components(told.select("base", "members"))
            return groups.select(F.explode("members").alias("member"), "base")

        nodes, edges = merged("semantic", (nodes, edges), judged)
        if model is not None:
            old = edges

            def completed() -> DataFrame:
                whole = clusters().join(resolve.complete_clusters(clusters().select("cluster", F.explode("members").alias("node")), near.toDF("lo", "hi")), "cluster", "left_semi")
                pairs = plugins.judged_clusters(whole, model, complete=True).withColumn("pos", F.lit(None).cast(old.schema["pos"].dataType))
                fresh = resolve.without_dangling(resolve.complete_by_rule(pairs), nodes)
                return old.unionByName(fresh, allowMissingColumns=True)

            edges = stage(spark, f"{out}/complete-edges", completed)
    final = nodes

    def interlayer() -> DataFrame:
        found = resolve.link_labels(graph.sentences.select(F.col("sentence_id").alias("text_id"), "text"), resolve.label_table(final))
        return links.union(resolve.interlayer_links(found, links, most)).distinct()

    linked = stage(spark, f"{out}/links", interlayer)
    return {"nodes": nodes, "edges": edges, "links": linked, "passages": stage(spark, f"{out}/passages", lambda: graph.passages), "sentences": stage(spark, f"{out}/sentences", lambda: graph.sentences)}


def embed(spark: SparkSession, rows: DataFrame, out: str, embedder: Callable, cells: int = 0) -> DataFrame:
    """Stage embed: rows (doc, text) as vectors by chunk, in coarse cells if a number is given."""
    from ..functions.text import fixed_chunks

    def made() -> DataFrame:
        chunks = rows.select("doc", F.posexplode(fixed_chunks("text")).alias("chunk", "text"))
        vectors = plugins.embed(chunks, embedder).drop("text")
        return dense.cells(vectors, cells)[0] if cells else vectors

    return stages.stage(spark, f"{out}/chunks", made, fingerprint(rows))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--stage", choices=STAGES, default="all")
    parser.add_argument("--documents", required=True, help="JSON array of title and content")
    parser.add_argument("--out", required=True, help="folder of the stage tables, shared by all executors")
    parser.add_argument("--model", help="module:function that answers (system, user, schema)")
    parser.add_argument("--ledger", help="folder of answers that are not asked for again; by default beside the stage tables")
    parser.add_argument("--embedder", help="module:function from texts to vectors")
    options = parser.parse_args(argv)
    if options.model is None and options.stage in ("er", "debug_er", "all"):
        parser.error("stages er and debug_er need --model: without one every document would be an error row")
    logging.basicConfig(level=logging.ERROR)

    def named(x: str | None):
        return getattr(importlib.import_module(x.partition(":")[0]), x.partition(":")[2]) if x else None

    model, embedder, ledger = named(options.model), named(options.embedder), options.ledger or f"{options.out}/ledger"
    spark = SparkSession.builder.getOrCreate()
    docs = files.titled_documents(spark, options.documents)
    docs = docs.select(F.sha2(F.concat_ws("\n", "title", "content"), 256).alias("doc"), "title", F.col("content").alias("text")).dropDuplicates(["doc"]).withColumn("pos", F.col("doc"))
    wanted = STAGES[:-1] if options.stage == "all" else (options.stage,)
    for name in wanted:
        log.info("stage %s", name)
        if name == "er":
            extract(spark, docs, options.out, model, ledger=ledger, name=options.model)
        elif name == "debug_er":
            repair(spark, options.out, model, ledger=ledger, name=f"{options.model} again")
        elif name == "align":
            align(spark, spark.read.parquet(f"{options.out}/repaired"), options.out, embedder, model)
        elif embedder is not None:
            embed(spark, docs, options.out, embedder)


if __name__ == "__main__":
    main()
