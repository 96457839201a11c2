"""Questions to contexts, all questions of a batch at once: seeds, time, subgraph, weights, PageRank, fusion, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.temporal import boost, decay, query_interval
from ..functions.text import intent, labelled, node_view
from ..operators import bm25, classes, dense, fusion, graph
from ..operators.linking import entity_names, keyword_seeds, resolved_names  # noqa: F401
from ..operators.resolve import distinct_undirected
from ..sources.stages import written

#: Questions that are broadcast; arcs of a question that one task may hold.
FEW, GROUPED_ARCS = 20_000, 5_000_000


def beside(questions: DataFrame) -> DataFrame:
    """Questions to be joined: broadcast if they are counted to be few."""
    return F.broadcast(questions) if questions.count() <= FEW else questions


def pagerank(arc_rows: DataFrame, nodes: DataFrame, seeds: DataFrame, config: Config, isolated: DataFrame | None = None) -> DataFrame:
    """PageRank to the tolerance, in one task a question if the largest question's arcs fit there, else by joins; isolated (question_id, n): counted nodes without arcs."""
    arc_rows = written(arc_rows, "arcs")
    most = arc_rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= GROUPED_ARCS:
        return graph.ppr_grouped(arc_rows, nodes, seeds, config.damping, config.iterations, config.tolerance, isolated)
    return graph.ppr(arc_rows, nodes, seeds, config.damping, config.iterations, tolerance=config.tolerance, isolated=isolated)


def timed(questions: DataFrame, config: Config = Config()) -> DataFrame:
    """questions (question_id, question): adds q_start, q_end and intent."""
    return questions.withColumn("_i", query_interval("question", config.default_query)).withColumns({"q_start": F.col("_i.start"), "q_end": F.col("_i.end"), "intent": intent("question")}).drop("_i")


def valid_nodes(members: DataFrame, times: DataFrame, questions: DataFrame, strict: bool = True) -> DataFrame:
    """members (question_id, node) that are valid at their question's time; a question that would lose all keeps all."""
    rows = members.join(graph.of_known(times, members, "node"), "node", "left").join(questions.select("question_id", "q_start", "q_end"), "question_id")
    return graph.time_filter(rows, ["question_id"], "start", "end", F.col("q_start"), F.col("q_end"), strict).select("question_id", "node")


def is_simple(pairs: DataFrame) -> bool:
    """Are these pairs (lo, hi) of a simple graph, or edges (src, dst, pos) that may be parallel?"""
    return "lo" in pairs.columns


def around(pairs: DataFrame, seeds: DataFrame, radius: int = 1) -> DataFrame:
    """The ball of pairs, or of edges."""
    return graph.ball(pairs if is_simple(pairs) else pairs.withColumnsRenamed({"src": "lo", "dst": "hi"}), seeds, radius)


def between(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs between members; of edges the last of parallel ones, found within the members."""
    return graph.induced(pairs, members) if is_simple(pairs) else graph.induced_simple(pairs, members)


def subgraph(pairs: DataFrame, times: DataFrame, questions: DataFrame, seeds: DataFrame, radius: int = 1, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (question_id, node) and induced pairs of each question's snapshot around its seeds, in a simple graph's pairs or in edges."""
    members = written(valid_nodes(around(pairs, seeds, radius), times, questions, strict), "members")
    return members, between(pairs, members)


def weighted(pairs: DataFrame, questions: DataFrame, config: Config = Config(), semantic=None, alpha: float | None = None) -> DataFrame:
    """pairs (question_id, lo, hi, start, end, ...) with w: time (to the query's end year) and meaning."""
    rows = pairs.join(beside(questions.select("question_id", "q_start", "q_end")), "question_id")
    year = F.coalesce(F.substring(F.coalesce("q_end", "q_start"), 1, 4).try_cast("double"), F.lit(config.default_year))
    return rows.withColumn("w", graph.edge_weight("start", "end", year, semantic, config.edge_weight_alpha if alpha is None else alpha, config.sigma))


def ranked_edges(pairs: DataFrame, scores: DataFrame, questions: DataFrame, semantic: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Pairs ranked by graph, time and meaning and fused with the weights of the question's intent; the best prune_top_k."""
    low = scores.select("question_id", F.col("node").alias("lo"), F.col("score").alias("_a"))
    high = scores.select("question_id", F.col("node").alias("hi"), F.col("score").alias("_b"))
    rows = pairs.join(low, ["question_id", "lo"]).join(high, ["question_id", "hi"]).withColumn("item", F.concat_ws("|", "lo", "hi"))
    year = F.coalesce(F.substring("q_start", 1, 4).try_cast("double"), F.lit(config.default_year))
    rows = rows.withColumns({"ppr": (F.col("_a") + F.col("_b")) / 2, "time": decay("start", "end", year, config.sigma)})
    by_graph, by_time = fusion.rank_by(rows, "ppr"), fusion.rank_by(rows, "time")
    weights = F.create_map(*[x for k, v in config.intent_weights.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = questions.select("question_id", weights[F.col("intent")].alias("_w")).join(fusion.top_overlap(by_graph, by_time), "question_id", "left")
    items = rows.select("question_id", "item", "lo", "hi", "relation", "ppr", "time").join(asked, "question_id")
    time = fusion.time_weight(F.col("_w")[2], "jaccard", config.overlap_limit, config.overlap_factor)
    found = {"ppr": (by_graph, F.col("_w")[0]), "time": (by_time, time)}
    if semantic is not None:
        found["sem"] = (semantic.withColumn("item", F.concat_ws("|", "lo", "hi")), F.col("_w")[1])
    out = fusion.rrf_join(items, found, config.rrf_edge)
    if semantic is None:
        from ..config import MISSING_RANK

        out = out.withColumn("rank_sem", F.lit(MISSING_RANK)).withColumn("score", F.col("score") + F.col("_w")[1] / (config.rrf_edge + MISSING_RANK))
    out = fusion.rank_by(out, "score")
    return out.where(F.col("rnk") <= config.prune_top_k).drop("_w", "jaccard")


def node_idf(bridge: DataFrame, passages: DataFrame) -> DataFrame:
    """bridge (passage, node): (node, idf), the logarithm of all passages over those with the node."""
    total = passages.agg(F.count_distinct("passage").alias("_n"), F.lit(0).alias("_k"))
    df = bridge.groupBy("node").agg(F.count_distinct("passage").alias("df")).withColumn("_k", F.lit(0))
    return df.join(F.broadcast(total), "_k").select("node", F.log(F.col("_n") / F.col("df")).alias("idf"))


def semantic_ranks(pairs: DataFrame, meaning: str = "sem") -> DataFrame:
    """pairs (question_id, lo, hi, meaning): (question_id, lo, hi, rnk) by falling meaning within the question's subgraph."""
    rows = pairs.select("question_id", "lo", "hi", F.concat_ws("|", "lo", "hi").alias("item"), meaning)
    return fusion.rank_by(rows, meaning).select("question_id", "lo", "hi", "rnk")


def with_meaning(pairs: DataFrame, meaning: DataFrame) -> DataFrame:
    """pairs with sem, the mean of their ends' likeness to the question; meaning (question_id, node, sim), 0 where it lacks a node."""
    end = lambda c: meaning.select("question_id", F.col("node").alias(c), F.col("sim").alias(f"_{c}"))
    out = pairs.join(end("lo"), ["question_id", "lo"], "left").join(end("hi"), ["question_id", "hi"], "left")
    mean = (F.coalesce("_lo", F.lit(0.0)) + F.coalesce("_hi", F.lit(0.0))) / 2
    return out.withColumn("sem", F.round(mean, 9)).drop("_lo", "_hi")


def ranked_passages(members: DataFrame, pairs: DataFrame, seeds: DataFrame, bridge: DataFrame, passages: DataFrame, questions: DataFrame, hybrid=None, config: Config = Config()) -> DataFrame:
    """The union of the passages of a question's nodes and of a text ranking (a table question_id, item, rnk, or `classes.Classes`), by PageRank over entities and passages fused with that ranking.

    Passages of the text ranking alone are nodes without arcs, which are counted and not listed. Questions without seeds have no rows.
    """
    bridge = written(graph.of_known(bridge, members, "node"), "bridge")
    idf = node_idf(bridge, passages)
    placed = graph.of_known(passages.select("passage", "start", "end"), bridge, "passage", node="passage")
    linked = bridge.join(members, "node").join(idf, "node").join(placed, "passage").join(beside(questions.select("question_id", "q_start", "q_end")), "question_id")
    linked = linked.withColumn("_w", F.col("idf") * boost("start", "end", "q_start", "q_end", config.boost_beta))
    linked = written(linked.select("question_id", "node", "passage", "_w"), "linked")
    places = linked.select("question_id", F.col("passage").alias("node")).distinct()
    isolated, text = None, None
    if hybrid is not None:
        text = classes.ranking(hybrid)
        seeded = seeds.select("question_id").distinct()
        places = written(places, "places")
        both = text.held(places.withColumnRenamed("node", "item")).groupBy("question_id").agg(F.count(F.lit(1)).alias("_both"))
        isolated = text.sizes.join(seeded, "question_id", "left_semi").join(both, "question_id", "left").select("question_id", (F.col("n") - F.coalesce("_both", F.lit(0))).alias("n"))
    scores = pagerank(graph.augmented(pairs, linked, F.col("_w")), members.unionByName(places), seeds, config, isolated)
    rows = places.join(scores, ["question_id", "node"], "left").select("question_id", F.col("node").alias("item"), F.coalesce("score", F.lit(0.0)).alias("score"))
    if text is None:
        by_graph = written(fusion.rank_by(rows, "score"), "passage-ranks")
        out = fusion.rrf_join(by_graph.select("question_id", "item", F.round("score", 12).alias("ppr")), {"ppr": (by_graph, 1.0)}, config.rrf_passage)
        return fusion.rank_by(out, "score").where(F.col("rnk") <= config.passage_top_k)
    return fused_passages(written(rows, "passage-scores"), text, seeded, config.rrf_passage, config.passage_top_k)


def fused_passages(scored: DataFrame, text, seeded: DataFrame, k: int, limit: int) -> DataFrame:
    """The first `limit` of the fusion of two rankings of scored (question_id, item, score) and a text ranking's other items: by score, where these have 0, and by text.

    As in `fusion.rrf_top`, an item that is in neither ranking's first `reach` scores less than each of the first `limit` of either. Items without a score stand behind those that have
    one, by id: their ranks are arithmetic on numbers in the text ranking's order of ids.
    """
    reach = 2 * (k + limit) - k
    scored = scored.withColumn("score", F.round("score", 12))
    above = written(fusion.rank_by(scored.where("score > 0"), "score"), "passages-above")
    counts = seeded.join(above.groupBy("question_id").agg(F.count(F.lit(1)).alias("above")), "question_id", "left").select("question_id", F.coalesce("above", F.lit(0)).alias("above"))
    short = written(counts.where(F.col("above") < reach).join(scored.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")), "question_id", "left"), "passages-short")
    first = above.where(F.col("rnk") <= reach).select("question_id", "item", "rnk")
    most = short.agg(F.max(F.coalesce("n", F.lit(0)))).first()[0]
    if most is not None:
        early = text.first(reach + most).select("question_id", "item").join(scored, ["question_id", "item"], "left_anti").unionByName(scored.where("score = 0").select("question_id", "item"))
        fill = early.join(short.select("question_id", "above"), "question_id")
        fill = fill.withColumn("rnk", F.row_number().over(Window.partitionBy("question_id").orderBy("item")) + F.col("above")).where(F.col("rnk") <= reach)
        first = first.unionByName(fill.select("question_id", "item", F.col("rnk").cast("int").alias("rnk")))
    first = written(first, "passages-first")
    best = written(text.top(reach).join(seeded, "question_id", "left_semi").select("question_id", "item", "rnk"), "passages-first")
    late = best.select("question_id", "item").join(first, ["question_id", "item"], "left_anti")
    by_score = above.select("question_id", "item", "rnk").join(late, ["question_id", "item"], "left_semi")
    behind = written(late.join(above, ["question_id", "item"], "left_anti"), "passages-behind")
    # Of the items by id, the text ranking's are counted; scored ones with a score above 0 are taken off, those with 0 that it lacks are added.
    ranked = text.held(scored.join(behind.select("question_id").distinct(), "question_id", "left_semi").select("question_id", "item")).select("question_id", "item", F.lit(1).alias("_in"))
    shift = scored.join(ranked, ["question_id", "item"], "left").select("question_id", "item", F.lit(1).alias("_kind"), (F.when(F.col("score") > 0, 0).otherwise(1) - F.coalesce("_in", F.lit(0))).alias("_d"))
    events = shift.join(behind.select("question_id").distinct(), "question_id", "left_semi").unionByName(behind.select("question_id", "item", F.lit(0).alias("_kind"), F.lit(0).alias("_d")))
    upto = Window.partitionBy("question_id").orderBy("item", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifted = events.withColumn("_d", F.sum("_d").over(upto)).where("_kind = 0").join(text.numbers(behind), ["question_id", "item"]).join(counts, "question_id")
    by_id = shifted.select("question_id", "item", (F.col("above") + F.col("before") + F.col("_d") + 1).alias("rnk"))
    by_graph = first.unionByName(by_score).unionByName(by_id)
    lacking = first.select("question_id", "item").join(best, ["question_id", "item"], "left_anti")
    by_text = best.unionByName(text.ranks(lacking).select("question_id", "item", "rnk"))
    items = by_graph.select("question_id", "item").join(scored, ["question_id", "item"], "left").select("question_id", "item", F.coalesce("score", F.lit(0.0)).alias("ppr"))
    out = fusion.rrf_join(items, {"ppr": (by_graph, 1.0), "sem": (by_text, 1.0)}, k)
    return fusion.rank_by(out, "score").where(F.col("rnk") <= limit)


def ranked_edges_two_way(pairs: DataFrame, scores: DataFrame, semantic: DataFrame, config: Config = Config()) -> DataFrame:
    """The path without time: pairs ranked by their ends' mean PageRank and by meaning, fused with equal weights; the best prune_top_k."""
    low = scores.select("question_id", F.col("node").alias("lo"), F.col("score").alias("_a"))
    high = scores.select("question_id", F.col("node").alias("hi"), F.col("score").alias("_b"))
    rows = pairs.join(low, ["question_id", "lo"]).join(high, ["question_id", "hi"]).withColumns({"item": F.concat_ws("|", "lo", "hi"), "ppr": (F.col("_a") + F.col("_b")) / 2}).drop("_a", "_b")
    meant = semantic.withColumn("item", F.concat_ws("|", "lo", "hi"))
    out = fusion.rrf_join(rows, {"ppr": (fusion.rank_by(rows, "ppr"), 1.0), "sem": (meant, 1.0)}, config.rrf_passage)
    return fusion.rank_by(out, "score").where(F.col("rnk") <= config.prune_top_k)


def fallback_passages(hybrid: DataFrame, k: int = 20) -> DataFrame:
    """The k best of a text ranking, the worst first."""
    best = hybrid.where(F.col("rnk") <= k)
    order = Window.partitionBy("question_id").orderBy(F.desc("rnk"))
    return best.withColumn("place", F.row_number().over(order))


def final_passages(graph_ranked: DataFrame, text_ranked: DataFrame, extra: int = 5) -> DataFrame:
    """question_id, passages: first the text ranking's extra passages that the graph lacks, best first, then the graph's, best first."""
    more = text_ranked.where(F.col("rnk") <= extra)
    both = graph_ranked.select("question_id", "item", F.lit(0).alias("_g"), (-F.col("rnk")).alias("_o")).unionByName(more.select("question_id", "item", F.lit(1).alias("_g"), (-F.col("rnk")).alias("_o")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_g", "_o", "item"))), lambda x: x["item"])
    return both.groupBy("question_id").agg(F.reverse(F.array_distinct(listed)).alias("passages"))


def labelled_edges(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Ranked edges (question_id, rnk, lo, relation, hi) with source and target labels, once for each undirected pair and relation."""
    if nodes is None:
        rows = edges.withColumns({"source": F.col("lo"), "target": F.col("hi")})
    else:
        names = nodes.select("id", "name", "type")
        a, b = names.toDF("lo", "_an", "_at"), names.toDF("hi", "_bn", "_bt")
        rows = edges.join(a, "lo", "left").join(b, "hi", "left").withColumns({"source": labelled("_an", "_at", "lo"), "target": labelled("_bn", "_bt", "hi")})
    return distinct_undirected(rows.select("question_id", "rnk", "source", "relation", "target"), position="rnk")


def entity_passages(named: DataFrame, bridge: DataFrame, hybrid, k: int = 10) -> DataFrame:
    """named (question_id, node): the question's k best passages (or sentences) of a text ranking that hold one of its nodes, the worst first: (question_id, item, place)."""
    held = graph.of_known(bridge, named, "node").join(named, "node").select("question_id", F.col("passage").alias("item")).distinct()
    order = Window.partitionBy("question_id").orderBy("order")
    best = classes.ranking(hybrid).held(held).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("_r")))).select("question_id", "item", "place")


def contexts(edges: DataFrame, seeds: DataFrame, passages: DataFrame, questions: DataFrame, nodes: DataFrame | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """One row a question: a JSON context of its labelled edges, the nodes among them that have aliases (seeds last), seeds, passages, sentences and, if questions have one, time.

    passages (question_id, passages array), sentences (question_id, rnk, text), nodes (id, name, type, description, aliases); without nodes ids stand for labels.
    """
    none = F.array().cast("array<string>")
    edges = written(edges.select("question_id", "rnk", "lo", "relation", "hi"), "edges")
    if nodes is not None:
        shown = edges.select(F.explode(F.array("lo", "hi")).alias("id")).union(seeds.select("node"))
        nodes = graph.of_known(nodes, shown, "id", node="id")
    line = lambda x: F.concat_ws(" | ", x["source"], x["relation"], x["target"])
    listed = labelled_edges(edges, nodes).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "source", "relation", "target"))), line).alias("relevant_graphs"))
    seed = seeds.groupBy("question_id").agg(F.array_sort(F.collect_set("node")).alias("seed_nodes"))
    rows = questions.join(listed, "question_id", "left").join(seed, "question_id", "left").join(passages, "question_id", "left")
    parts = [F.coalesce(c, none).alias(n) for c, n in (("relevant_graphs", "relevant_graphs"), ("passages", "relevant_passages"), ("seed_nodes", "seed_nodes"))]
    if nodes is not None:
        touched = edges.select("question_id", F.explode(F.array("lo", "hi")).alias("id")).union(seeds.select("question_id", F.col("node").alias("id"))).distinct()
        marked = touched.join(seeds.select("question_id", F.col("node").alias("id"), F.lit(True).alias("_seed")).distinct(), ["question_id", "id"], "left")
        shown = marked.join(nodes, "id").withColumn("_v", node_view("name", "type", "description", "aliases")).where("_v IS NOT NULL")
        views = shown.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_seed", F.lit(False)).alias("s"), "id", "_v"))), lambda x: x["_v"]).alias("nodes_alias_information"))
        rows = rows.join(views, "question_id", "left")
        parts.append(F.col("nodes_alias_information"))
    if sentences is not None:
        told = sentences.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "text"))), lambda x: x["text"]).alias("relevant_sentences"))
        rows = rows.join(told, "question_id", "left")
        parts.append(F.coalesce("relevant_sentences", none).alias("relevant_sentences"))
    if "q_start" in questions.columns:
        parts.append(F.struct(F.col("q_start").alias("start"), F.col("q_end").alias("end")).alias("query_timestamp"))
    return rows.select("question_id", F.to_json(F.struct(*parts)).alias("context"))


def with_texts(ordered: DataFrame, passages: DataFrame) -> DataFrame:
    """(question_id, passages) with the passages' texts in place of their ids, if passages have texts."""
    if "text" not in passages.columns:
        return ordered
    rows = ordered.select("question_id", F.posexplode("passages").alias("_p", "passage")).join(passages.select("passage", "text"), "passage")
    return rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "text"))), lambda x: x["text"]).alias("passages"))


def retrieve_temporal(questions: DataFrame, names: DataFrame, pairs: DataFrame, times: DataFrame, bridge: DataFrame, passages: DataFrame, hybrid, config: Config = Config(), meaning: DataFrame | None = None, nodes: DataFrame | None = None, sentences: DataFrame | None = None, linked: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """The whole path for a batch: question_id, context.

    names (node, name), pairs (lo, hi, relation, start, end) or edges (src, dst, relation, start, end, pos), times (node, start, end), bridge (passage, node), passages (passage, start, end
    and perhaps text), hybrid (question_id, item, rnk) or `classes.Classes`. meaning (question_id, node, sim) gives edge weights and the edges'
    ranking by meaning; without it edges count half there and are not ranked by it. nodes give labels, sentences (question_id, rnk,
    text) the context's sentences, linked (question_id, name) names that an entity linker found beside those in the question's
    words. found (question_id, node) are the entities in the questions' words, if they are known. Questions without an entity get the text ranking alone.
    """
    asked = written(timed(questions, config), "asked")
    seeds = keyword_seeds(asked, names) if found is None else found
    if linked is not None:
        seeds = seeds.union(resolved_names(linked, names)).distinct()
    seeds = written(valid_nodes(seeds, times, asked, config.snapshot_strictness), "seeds")
    members, inside = subgraph(pairs, times, asked, seeds, 1, config.snapshot_strictness)
    if meaning is not None:
        inside = with_meaning(inside, meaning)
    inside = written(weighted(inside, asked, config, None if meaning is None else F.col("sem")), "pairs")
    scores = written(pagerank(graph.arcs(inside, "w"), members, seeds, config), "scores")
    edges = ranked_edges(inside, scores, asked, None if meaning is None else semantic_ranks(inside), config)
    hybrid = classes.ranking(hybrid)
    places = ranked_passages(members, inside, seeds, bridge, passages, asked, hybrid, config)
    # Without seeds there are no graph passages: the text ranking's own first ones, as many as a fallback gives.
    lacking = asked.select("question_id").join(seeds.select("question_id").distinct(), "question_id", "left_anti")
    first = written(hybrid.top(max(config.passage_top_k, config.similarity_passage_top_k)).select("question_id", "item", "rnk"), "text-first")
    alone = first.join(lacking, "question_id", "left_semi").where(F.col("rnk") <= config.passage_top_k)
    best = places.where(F.col("rnk") <= config.entity_passage_top_k).select("question_id", "item", "rnk").unionByName(alone.select("question_id", "item", "rnk"))
    ordered = with_texts(final_passages(best, first, config.similarity_passage_top_k), passages)
    return contexts(edges, seeds, ordered, asked, nodes, sentences)


def untimed_passages(questions: DataFrame, seeds: DataFrame, members: DataFrame, inside: DataFrame, bridge: DataFrame, hybrid, config: Config) -> DataFrame:
    """question_id, item, rnk: passages of the ball by unweighted PageRank fused with the text ranking; questions without seeds get the text ranking's first, the worst first."""
    linked = written(graph.of_known(bridge, members, "node").join(members, "node"), "linked")
    places = linked.select("question_id", F.col("passage").alias("node")).distinct()
    scores = pagerank(graph.augmented(inside, linked), members.unionByName(places), seeds, config)
    rows = scores.join(places, ["question_id", "node"], "left_semi").withColumnRenamed("node", "item")
    by_graph = written(fusion.rank_by(rows, "score"), "passage-ranks")
    hybrid = classes.ranking(hybrid)
    out = fusion.rrf_join(by_graph.select("question_id", "item"), {"ppr": (by_graph, 1.0), "sem": (hybrid.ranks(by_graph.select("question_id", "item")), 1.0)}, config.rrf_passage)
    found = fusion.rank_by(out, "score").where(F.col("rnk") <= config.entity_passage_top_k).select("question_id", "item", "rnk")
    lacking = questions.select("question_id").join(seeds.select("question_id").distinct(), "question_id", "left_anti")
    alone = fallback_passages(hybrid.top(config.passage_top_k), config.passage_top_k).join(lacking, "question_id", "left_semi")
    return found.unionByName(alone.select("question_id", "item", F.col("place").alias("rnk")))


def retrieve(questions: DataFrame, names: DataFrame, pairs: DataFrame, bridge: DataFrame, hybrid, config: Config = Config()) -> DataFrame:
    """The path without time: question_id, item, rnk of passages; unweighted PageRank fused with the text ranking."""
    seeds = written(keyword_seeds(questions, names), "seeds")
    members = written(around(pairs, seeds, 1), "members")
    inside = written(between(pairs, members).withColumn("w", F.lit(1.0)), "inside")
    return untimed_passages(questions, seeds, members, inside, bridge, hybrid, config)


def retrieve_graph(questions: DataFrame, names: DataFrame, edges: DataFrame, bridge: DataFrame, hybrid, triplets: DataFrame, config: Config = Config(), nodes: DataFrame | None = None, passages: DataFrame | None = None, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The path without time, with the graph's part of the context: question_id, context.

    edges (src, dst, relation, pos, ...), triplets (question_id, src, dst, rnk) as a text or vector ranking orders them: those that are edges of the ball in their own
    direction are fused with the ends' mean PageRank; the rest as in `retrieve`. Questions without an entity get passages alone. found: seeds and the ball around them, if they are known.
    """
    seeds = written(keyword_seeds(questions, names), "seeds") if found is None else found[0]
    members = written(around(edges, seeds, 1), "members") if found is None else found[1]
    inside = written(between(edges.withColumn("from", F.col("src")), members).drop("pos").withColumn("w", F.lit(1.0)), "inside")
    scores = written(pagerank(graph.arcs(inside, "w"), members, seeds, config), "scores")
    forth = F.col("from") == F.col("lo")
    directed = inside.select("question_id", F.col("from").alias("src"), F.when(forth, F.col("hi")).otherwise(F.col("lo")).alias("dst"))
    meant = fusion.oriented_edge_rank(triplets, directed).select("question_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "rnk")
    best = ranked_edges_two_way(inside, scores, meant, config)
    found = written(untimed_passages(questions, seeds, members, inside, bridge, hybrid, config), "found")
    seeded = seeds.select("question_id").distinct()
    first = classes.ranking(hybrid).top(config.similarity_passage_top_k).select("question_id", "item", "rnk")
    ordered = final_passages(found.join(seeded, "question_id", "left_semi"), first.join(seeded, "question_id", "left_semi"), config.similarity_passage_top_k)
    alone = found.join(seeded, "question_id", "left_anti").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "item"))), lambda x: x["item"]).alias("passages"))
    ordered = ordered.unionByName(alone)
    return contexts(best, seeds, ordered if passages is None else with_texts(ordered, passages), questions, nodes)


def layer_rankings(questions: DataFrame, layers: dict[str, DataFrame], k: int, vectors: dict[str, DataFrame] | None = None, asked: DataFrame | None = None) -> dict[str, DataFrame]:
    """The first k of each layer for each question: layers by name (item, text), such as passages, sentences, triplets and ontology strings.

    By BM25; a layer with vectors (item, embedding) by its fusion with the nearest vectors of asked (question_id, query). No ranking is made whole.
    """
    out = {}
    for name, rows in layers.items():
        index = bm25.build(rows, "item", "text")
        if vectors and name in vectors:
            first = bm25.ranking(bm25.scores(index, questions, "question_id", "question"), questions, rows, "question_id", "item")
            chunks = vectors[name].select(F.col("item").alias("chunk"), F.col("item").alias("doc"), "embedding")
            out[name] = fusion.rrf_top([first, dense.ranking(chunks, asked)], k).select("question_id", "item", "rnk")
        else:
            out[name] = classes.Classes(index, questions).top_of_all(k, questions, index.tokens.select("doc"))
    return out
