"""Entity resolution: exact and semantic alignment, merging, rewiring, linking across layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, label_allowed
from ..sources.stages import written
from .fusion import in_order
from .graph import components
from .matching import longest as longest_spans
from .matching import substring_spans, word_spans
from .near import near_pairs

#: Edges that a task rewires.
EDGES = 200_000


def name_groups(nodes: DataFrame) -> DataFrame:
    """Nodes by exact name: name, members (ids in order of position)."""
    return nodes.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("members"))


def exact_links(nodes: DataFrame) -> DataFrame:
    """Links between nodes of the same name that share a type: each node with the least id of its (name, type).

    Stars instead of pairs: the components are those of all pairs, and a name of any frequency gives one link a type of each node.
    """
    typed = nodes.select("id", "name", F.explode(F.array_distinct("type")).alias("_type"))
    hub = typed.groupBy("name", "_type").agg(F.min("id").alias("a"))
    return typed.join(hub, ["name", "_type"]).where("a <> id").select("a", F.col("id").alias("b")).distinct()


def align_exact(nodes: DataFrame) -> DataFrame:
    """(member, base) of all nodes that are one entity by name and type; the base is the least id."""
    return components(exact_links(nodes)).select(F.col("node").alias("member"), F.col("component").alias("base"))


def instruction_components(instructions: DataFrame) -> DataFrame:
    """instructions (base, members array): (base, members) of their connected components, base the least id, members sorted."""
    links = instructions.select(F.col("base").alias("a"), F.explode("members").alias("b"))
    found = components(links)
    grouped = found.where("node <> component").groupBy(F.col("component").alias("base"))
    return grouped.agg(F.array_sort(F.collect_set("node")).alias("members"))


def merge_nodes(nodes: DataFrame, mapping: DataFrame, keep_names: bool = False) -> DataFrame:
    """nodes (id, pos, name, type, aliases, description, ...) with members folded into their base (mapping: member, base).

    Types and aliases are united (null counts as empty), descriptions joined by new lines in order, of properties (a map) each key's first value stays;
    every other column is the base's. Nodes that are alone are not grouped.
    """
    ends = mapping.select("member").union(mapping.select("base")).distinct().withColumnRenamed("member", "id")
    alone = nodes.join(ends, "id", "left_anti")
    based = nodes.join(ends, "id", "left_semi").join(mapping, nodes["id"] == mapping["member"], "left").withColumn("_base", F.coalesce("base", "id")).drop("member", "base")
    based = based.withColumn("_first", F.struct((F.col("id") != F.col("_base")).alias("other"), "pos"))
    first = F.col("_first")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col(c).alias("v")))), lambda x: x["v"])
    names = F.filter(in_order("name"), lambda x: x != F.min_by("name", first))
    listed = lambda c: F.flatten(F.filter(in_order(c), lambda x: x.isNotNull()))
    aliases = listed("aliases")
    united = {
        "pos": F.min("pos"),
        "type": F.array_distinct(listed("type")),
        "aliases": F.array_distinct(F.concat(aliases, names) if keep_names else aliases),
        "description": F.array_join(F.filter(in_order("description"), lambda x: F.coalesce(x, F.lit("")) != ""), "\n"),
    }
    aggregates = [united.get(c, F.min_by(c, first)).alias(f"_new_{c}") for c in nodes.columns if c not in ("id", "properties")]
    merged = based.groupBy("_base").agg(*aggregates)
    if "properties" in nodes.columns:
        merged = merged.join(first_properties(based), "_base")
    merged = merged.select(*[F.col("_base" if c == "id" else f"_new_{c}").alias(c) for c in nodes.columns])
    none = F.array().cast("array<string>")
    plain = {"aliases": F.coalesce("aliases", none), "description": F.coalesce("description", F.lit("")), "type": F.array_distinct(F.coalesce("type", none))}
    return alone.withColumns(plain).select(nodes.columns).unionByName(merged)


def first_properties(based: DataFrame) -> DataFrame:
    """based (_base, _first, properties): (_base, _new_properties), each key's first value in order; an empty map where no node has a property.

    Keys meet by an exchange: comparing a base's entries with one another would cost the square of its members.
    """
    at = F.struct("_first", "_k").alias("_at")
    entries = based.select("_base", "_first", F.posexplode("properties").alias("_k", "key", "value")).select("_base", "key", F.struct(at, "value").alias("_e"))
    once = entries.groupBy("_base", "key").agg(F.min_by("_e", F.col("_e._at")).alias("_e"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_e._at").alias("at"), "key", F.col("_e.value").alias("value"))))
    kept = once.groupBy("_base").agg(F.map_from_entries(F.transform(listed, lambda x: F.struct(x["key"], x["value"]))).alias("_map"))
    every = based.select("_base").distinct().join(kept, "_base", "left")
    none = F.map_from_arrays(F.array(), F.array()).cast(based.schema["properties"].dataType)
    return every.select("_base", F.coalesce("_map", none).alias("_new_properties"))


def rewired(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between bases, without loops, the first of equal (src, dst, relation) by position."""
    end = lambda c: mapping.select(F.col("member").alias(c), F.col("base").alias(f"_{c}"))
    edges = written(edges, "edges")
    parts = -(-edges.count() // EDGES) + 1  # a task's sorts stay of one size, whatever the table's
    out = edges.repartition(parts, "src").join(end("src"), "src", "left").repartition(parts, "dst").join(end("dst"), "dst", "left")
    out = out.withColumns({"src": F.coalesce("_src", "src"), "dst": F.coalesce("_dst", "dst")}).drop("_src", "_dst")
    return first_edges(out.where("src <> dst").repartition(parts, "src", "dst", "relation"))


def first_edges(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("src", "dst", "relation")]
    return edges.groupBy("src", "dst", "relation").agg(F.min_by(F.struct(*others), "pos").alias("_e")).select("src", "dst", "relation", "_e.*")


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def cluster_gates(clusters: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """clusters (cluster, names): those of fitting size whose names all have a letter."""
    fits = F.size("names").between(least, most) & ~F.exists("names", lambda n: ~n.rlike("[a-zA-Z]"))
    return clusters.where(fits)


def complete_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """members (cluster, node), pairs (lo, hi): clusters in which every two nodes are adjacent."""
    a, b = members.select("cluster", F.col("node").alias("lo")), members.select("cluster", F.col("node").alias("hi"))
    inside = pairs.select("lo", "hi").distinct().join(a, "lo").join(b, ["cluster", "hi"]).groupBy("cluster").agg(F.count(F.lit(1)).alias("_e"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.join(inside, "cluster").where(F.col("_e") * 2 == F.col("_n") * (F.col("_n") - 1)).select("cluster")


def merge_by_rule(clusters: DataFrame, same: Column) -> DataFrame:
    """A rule in place of a model's judgement: clusters (cluster, members) for which `same` holds, as instructions."""
    return clusters.where(same).select(F.array_min("members").alias("base"), F.array_except("members", F.array(F.array_min("members"))).alias("members"))


def complete_by_rule(pairs: DataFrame, position: str = "pos", relation: str = "related_to") -> DataFrame:
    """Predicted pairs (entity_1, entity_2) as edges from the second to the first."""
    return pairs.select(F.col("entity_2").alias("src"), F.col("entity_1").alias("dst"), F.lit(relation).alias("relation"), position).where("src <> dst")


def label_table(nodes: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """nodes (id, pos, name, aliases): allowed folded labels; of nodes with the same label the last stays. common (label): words too frequent to link."""
    named = nodes.select("id", "pos", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_l"))
    labels = named.select(fold("_l").alias("label"), "id", "pos").where(label_allowed("label"))
    if common is not None:
        labels = labels.join(common.select("label"), "label", "left_anti")
    return labels.groupBy("label").agg(F.max_by("id", F.struct("pos", "id")).alias("id"))


def link_labels(texts: DataFrame, labels: DataFrame, within_words: bool = False, longest: bool = False) -> DataFrame:
    """texts (text_id, text), labels (label, id): (text_id, id, occurrences) of labels that occur as whole words, or as any substring.

    Overlapping labels count each; with `longest` those alone that a reader from left to right takes.
    """
    spans = (substring_spans if within_words else word_spans)(texts, labels)
    counted = (longest_spans(spans) if longest else spans).groupBy("text_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(labels, "label").groupBy("text_id", "id").agg(F.sum("n").alias("occurrences"))


def interlayer_links(found: DataFrame, known: DataFrame, most: int = 100) -> DataFrame:
    """New links (text_id, id) of nodes that occur at most `most` times in all, without those known."""
    often = found.groupBy("id").agg(F.sum("occurrences").alias("n")).where(F.col("n") > most).select("id")
    return found.join(often, "id", "left_anti").join(known, ["text_id", "id"], "left_anti").select("text_id", "id")


def semantic_clusters(rows: DataFrame, eps: float = 0.5) -> DataFrame:
    """(node, component) of density clusters with two or more members: with that minimum they are the eps-graph's components."""
    return components(near_pairs(rows, eps, forest=True))


def combined(graphs: list[DataFrame], ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """One table of several graphs' rows; the columns in `ids` get the graph's number before them, so that equal ids of different graphs stay apart."""
    rows = [g.withColumns({c: F.concat(F.lit(f"{k}:"), c) for c in ids} | {"graph": F.lit(k)}) for k, g in enumerate(graphs)]
    return reduce(DataFrame.unionByName, rows)


def combined_graph(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (src, dst, relation, pos, ...) of several graphs as one: ids apart, without loops, the first of equal edges."""
    joined = combined(edges, ("src", "dst")).withColumn("pos", F.struct("graph", "pos")).drop("graph")
    return combined(nodes), first_edges(joined.where("src <> dst"))


def distinct_undirected(edges: DataFrame, source: str = "source", target: str = "target", relation: str = "relation", position: str = "pos") -> DataFrame:
    """Of labelled edges that differ in direction alone the first by position, within each question if there is one."""
    keys = [c for c in ("question_id",) if c in edges.columns]
    pair = F.array_sort(F.array(source, target))
    rows = edges.withColumn("_pair", pair)
    others = F.struct(*[c for c in edges.columns if c not in (*keys, relation)])
    return rows.groupBy(*keys, "_pair", relation).agg(F.min_by(others, position).alias("_e")).select(*keys, relation, "_e.*").select(edges.columns)


def blank_descriptions(nodes: DataFrame) -> DataFrame:
    """Nodes as a judge sees them: without descriptions."""
    return nodes.withColumn("description", F.lit(""))


def reset_ids(nodes: DataFrame, order: list[str], mode: str = "number") -> DataFrame:
    """nodes with `new_id`: 1..n in the order given, or a hash of the id. Numbers are dealt in two levels, without one task for all."""
    if mode == "hash":
        return nodes.withColumn("new_id", F.sha2(F.col("id"), 256))
    if mode != "number":
        raise ValueError(f"unknown mode {mode!r}")
    return in_order(nodes, order, "new_id").withColumn("new_id", F.col("new_id").cast("string"))
