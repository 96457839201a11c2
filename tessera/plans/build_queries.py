"""Queries of construction, resolution, evaluation and data preparation, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import build, evaluate, resolve
from . import kg
from .registry import query

STARS = f"""{kg.PARTS}, ty AS (SELECT id, name, unnest(type) AS ty FROM parts), hub AS (SELECT name, ty, min(id) AS a FROM ty GROUP BY ALL), links AS (SELECT DISTINCT a, id AS b FROM ty JOIN hub USING (name, ty) WHERE a <> id),
  both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links), cc AS (WITH RECURSIVE r(node, root) AS (SELECT a, a FROM both_ UNION SELECT b, root FROM r JOIN both_ ON node = a) SELECT node AS member, min(root) AS base FROM r GROUP BY node)"""


def alignment(t):
    return resolve.align_exact(kg.parts(t))


@query("align_exact_clusters", f"WITH {STARS} SELECT member, base FROM cc")
def align_exact_clusters(t):
    return alignment(t)


MERGED = f"""{STARS}, b AS (SELECT p.*, coalesce(base, id) AS base FROM parts p LEFT JOIN cc ON member = id), o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id <> base, pos) AS k FROM b)"""


def timed_parts(t):
    """Parts with a time, properties and a mark, so that a merge has to keep them; some lack a type."""
    k = F.col("pos")
    start = F.concat((F.lit(1990) + k % 10).cast("string"), F.lit("-01-01"))
    return kg.parts(t).withColumns({"properties": F.create_map(F.lit("kept"), k.cast("string"), F.concat(F.lit("own"), k), F.lit("x")), "valid_time": F.struct(start.alias("start"), F.lit(None).cast("string").alias("end")), "is_temporal_entity": k % 3 == 0, "type": F.when(k % 11 != 0, F.col("type"))})


@query("merge_nodes", f"""WITH {MERGED}, g AS (SELECT base AS id, min(pos) AS pos, first(name ORDER BY k) AS name, flatten(list(type ORDER BY k) FILTER (pos % 11 <> 0)) AS ty, flatten(list(aliases ORDER BY k)) AS al, string_agg(description, chr(10) ORDER BY k) AS description, first(pos ORDER BY k) AS own, list(pos ORDER BY k) AS all_ FROM o GROUP BY base)
  SELECT id, pos, name, coalesce(array_to_string(list_sort(list_distinct(ty)), ','), '') AS type, len(list_distinct(al))::BIGINT AS aliases, md5(description) AS digest, (1990 + own % 10) || '-01-01' AS start, own % 3 = 0 AS temporal, own::VARCHAR AS kept, (len(list_distinct(all_)) + 1)::BIGINT AS properties FROM g""")
def merge_nodes(t):
    out = resolve.merge_nodes(timed_parts(t), alignment(t))
    return out.select(
        "id", "pos", "name", F.array_join(F.array_sort("type"), ",").alias("type"), F.size("aliases").cast("long").alias("aliases"), F.md5("description").alias("digest"), "valid_time.start",
        F.col("is_temporal_entity").alias("temporal"), F.col("properties")["kept"].alias("kept"), F.size(F.map_keys("properties")).cast("long").alias("properties"),
    )


@query("edge_rewire_dedup", f"""WITH {STARS}, {kg.EDGES}, r AS (SELECT src, coalesce(base, dst) AS dst, relation, start, pos FROM supplies LEFT JOIN cc ON member = dst) SELECT src, dst, relation, first(start ORDER BY pos) AS start FROM r WHERE src <> dst GROUP BY ALL""")
def edge_rewire_dedup(t):
    return resolve.rewired(kg.supplies(t), alignment(t)).select("src", "dst", "relation", "start")


@query("name_groups_type_overlap", f"""WITH {kg.PARTS} SELECT a.name, count(*) AS pairs FROM parts a JOIN parts b ON a.name = b.name AND a.id < b.id AND len(list_intersect(a.type, b.type)) > 0 GROUP BY a.name""")
def name_groups_type_overlap(t):
    # Counted without making pairs: by inclusion and exclusion over the two types that a part has.
    rows = kg.parts(t).select("name", F.col("type")[0].alias("x"), F.col("type")[1].alias("y"))
    pairs = lambda *by: rows.groupBy("name", *by).agg(F.count(F.lit(1)).alias("c")).groupBy("name").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("_".join(("n", *by))))
    out = pairs("x").join(pairs("y"), "name").join(pairs("x", "y"), "name")
    return out.select("name", (F.col("n_x") + F.col("n_y") - F.col("n_x_y")).alias("pairs")).where("pairs > 0")


@query("name_groups", f"WITH {kg.PARTS} SELECT name, array_to_string(list(id ORDER BY pos, id), ',') AS members FROM parts GROUP BY name")
def name_groups(t):
    return resolve.name_groups(kg.parts(t)).select("name", F.array_join("members", ",").alias("members"))


@query("merge_instruction_components", """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + d AS b FROM part, (VALUES (1), (2)) v(d) WHERE p_size % 4 = 0), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(node, root) AS (SELECT a, a FROM both_ UNION SELECT b, root FROM r JOIN both_ ON node = a), c AS (SELECT node, min(root) AS base FROM r GROUP BY node) SELECT base, array_to_string(list(node ORDER BY node), ',') AS members FROM c WHERE node <> base GROUP BY base""")
def merge_instruction_components(t):
    """Each part of some sizes tells to merge the two after it; instructions that share a part are one."""
    rows = t.part.where("p_size % 4 = 0").select(F.col("p_partkey").alias("base"), F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 2).alias("members"))
    return resolve.instruction_components(rows).select("base", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


NEAR = """near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) >= 0.4),
  cl AS (WITH RECURSIVE r(node, root) AS (SELECT a, a FROM near UNION SELECT b, root FROM r JOIN near ON node = a) SELECT node, min(root) AS component FROM r GROUP BY node)"""


def clusters(t):
    return resolve.semantic_clusters(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 0.6)


@query("semantic_clusters", f"WITH {NEAR} SELECT node, component FROM cl")
def semantic_clusters(t):
    return clusters(t)


GATED = f"{NEAR}, m AS (SELECT component, list_sort(list(node)) AS members, list(p_name) AS names FROM cl JOIN part ON p_partkey = node GROUP BY component)"


def gated(t):
    named = clusters(t).join(t.part.select(F.col("p_partkey").alias("node"), "p_name"), "node")
    grouped = named.groupBy(F.col("component").alias("cluster")).agg(F.array_sort(F.collect_list("node")).alias("members"), F.collect_list("p_name").alias("names"))
    return resolve.cluster_gates(grouped)


@query("semantic_merge_rule", f"WITH {GATED} SELECT members[1] AS base, array_to_string(members[2:], ',') AS members FROM m WHERE len(members) BETWEEN 2 AND 50 AND members[1] % 2 = 0")
def semantic_merge_rule(t):
    out = resolve.merge_by_rule(gated(t), F.array_min("members") % 2 == 0)
    return out.select("base", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("semantic_complete_rule", f"""WITH {GATED}, c AS (SELECT component FROM m WHERE len(members) BETWEEN 2 AND 50 AND (SELECT count(*) FROM near WHERE list_contains(members, near.a) AND list_contains(members, near.b)) = len(members) * (len(members) - 1))
  SELECT a.node::VARCHAR AS dst, b.node::VARCHAR AS src, 'related_to' AS relation FROM cl a JOIN cl b USING (component) WHERE a.node < b.node AND component IN (FROM c)""")
def semantic_complete_rule(t):
    member = gated(t).select("cluster", F.explode("members").alias("node"))
    pairs = resolve.near_pairs(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 0.6).toDF("lo", "hi")
    whole = resolve.complete_clusters(member, pairs)
    inside = pairs.join(member.join(whole, "cluster").select("cluster", F.col("node").alias("lo")), "lo")
    judged = inside.select(F.col("lo").cast("string").alias("entity_1"), F.col("hi").cast("string").alias("entity_2"), F.lit(0).alias("pos"))
    return resolve.complete_by_rule(judged).drop("pos")


@query("combine_graphs", """WITH g(graph, id, name) AS (SELECT 0, r_regionkey, r_name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation),
  e(graph, src, dst, relation, pos) AS (SELECT 0, r_regionkey, (r_regionkey + 1) % 5, 'beside', r_regionkey FROM region UNION ALL SELECT 0, r_regionkey, r_regionkey, 'self', r_regionkey + 10 FROM region UNION ALL SELECT 1, n_nationkey, n_regionkey, 'beside', n_nationkey FROM nation UNION ALL SELECT 1, n_nationkey, n_regionkey, 'beside', n_nationkey + 100 FROM nation)
  SELECT a.graph || ':' || a.src AS src, a.graph || ':' || a.dst AS dst, relation, x.name AS source, y.name AS target, min(pos)::BIGINT AS pos FROM e a JOIN g x ON x.graph = a.graph AND x.id = src JOIN g y ON y.graph = a.graph AND y.id = dst WHERE src <> dst GROUP BY ALL""")
def combine_graphs(t):
    """Regions and nations as two graphs whose ids are the same numbers."""
    nodes = [t.region.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name")), t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))]
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    edge = lambda df, a, b, kind, pos: df.select(a.cast("string").alias("src"), b.cast("string").alias("dst"), F.lit(kind).alias("relation"), pos.cast("long").alias("pos"))
    first = edge(t.region, r, (r + 1) % 5, "beside", r).union(edge(t.region, r, r, "self", r + 10))
    second = edge(t.nation, n, F.col("n_regionkey"), "beside", n).union(edge(t.nation, n, F.col("n_regionkey"), "beside", n + 100))
    every, edges = resolve.combined_graph(nodes, [first, second])
    named = edges.join(every.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(every.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    return named.select("src", "dst", "relation", "source", "target", "pos.pos")


@query("undirected_edge_dedup", """WITH e AS (SELECT l_suppkey::VARCHAR AS a, (l_partkey % 100)::VARCHAR AS b, l_returnflag AS relation, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)
  SELECT least(a, b) AS lo, greatest(a, b) AS hi, relation, arg_min(a, pos) AS source, min(pos) AS pos FROM e GROUP BY 1, 2, 3""")
def undirected_edge_dedup(t):
    rows = t.lineitem.select(F.col("l_suppkey").cast("string").alias("source"), (F.col("l_partkey") % 100).cast("string").alias("target"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    out = resolve.distinct_undirected(rows)
    return out.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), "relation", "source", "pos")


@query("judge_cluster_view", f"WITH {kg.PARTS} SELECT id, '' AS description FROM parts")
def judge_cluster_view(t):
    return resolve.blank_descriptions(kg.parts(t)).select("id", "description")


@query("property_merge", "SELECT event_id, coalesce(props, '') AS first_wins, event_type AS last_wins FROM events")
def property_merge(t):
    one = F.create_map(F.lit("a"), F.coalesce("props", F.lit("")), F.lit("b"), F.lit("x"))
    two = F.create_map(F.lit("a"), F.col("event_type"))
    rows = t.events.withColumns({"one": one, "two": two})
    return rows.select("event_id", X.merged_map("one", "two", False)["a"].alias("first_wins"), X.merged_map("one", "two")["a"].alias("last_wins"))


@query("reset_node_id", f"WITH {kg.PLACES} SELECT id, row_number() OVER (ORDER BY pos)::VARCHAR AS new_id FROM places")
def reset_node_id(t):
    return resolve.reset_ids(kg.places(t), ["pos"]).select("id", "new_id")


@query("id_remap_edges", f"WITH {kg.PLACES}, {kg.EDGES}, m AS (SELECT id, row_number() OVER (ORDER BY pos)::VARCHAR AS n FROM places) SELECT a.n AS src, b.n AS dst, relation FROM located JOIN m a ON a.id = src JOIN m b ON b.id = dst")
def id_remap_edges(t):
    m = reset_node_id(t)
    rows = kg.located(t).join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst")
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation")


@query("zip_by_key", "SELECT c_custkey AS k, c_name AS doc, o.total AS result FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def zip_by_key(t):
    """Documents and results that were computed apart, put together by their row's key."""
    docs, results = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("doc")), t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("result"))
    return build.zipped(docs, results, "k")


def responses(t):
    """A model's answers, some fenced, some malformed, made from the orders."""
    k = F.col("o_orderkey") % 4
    node = F.format_string('{"id":"1","name":"Order %d","type":["Event"],"description":"","aliases":[],"is_temporal_entity":false,"valid_time":{"start":"%s","end":""}}', "o_orderkey", F.to_date("o_orderdate").cast("string"))
    other = F.format_string('{"id":"2","name":"Customer %d","type":["Person"],"description":"","aliases":[],"is_temporal_entity":false,"valid_time":{"start":"","end":""}}', "o_custkey")
    edge = F.lit('{"source_node_id":"2","target_node_id":"1","relationship_name":"placed","valid_time":{"start":"","end":""}},{"source_node_id":"2","target_node_id":"9","relationship_name":"lost","valid_time":{"start":"","end":""}}')
    good = F.concat(F.lit('{"nodes":['), node, F.lit(","), other, F.lit('],"edges":['), edge, F.lit("]}"))
    text = F.when(k == 0, good).when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k == 2, F.lit("no object")).otherwise(F.lit('{"edges": []}'))
    return t.orders.select(F.col("o_orderkey").cast("string").alias("doc"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("Order "), "o_orderkey", F.lit(" was placed. Customer "), "o_custkey", F.lit(" waits.")).alias("text"), text.alias("response"))


@query("entity_layer_json_parse", "SELECT o_orderkey::VARCHAR AS doc, CASE WHEN o_orderkey % 4 < 2 THEN 2 END AS nodes, CASE WHEN o_orderkey % 4 < 2 THEN 2 END AS edges FROM orders")
def entity_layer_json_parse(t):
    rows = build.extracted(responses(t))
    n = lambda c: F.when(F.col("entity_layer").isNotNull(), F.size(f"entity_layer.{c}"))
    return rows.select("doc", n("nodes").alias("nodes"), n("edges").alias("edges"))


@query("llm_json_repair", """SELECT event_id, 'd' || event_type AS a, event_type || ' "x"' AS b FROM events""")
def llm_json_repair(t):
    """Fenced answers with a backslash that begins no escape, and with escapes that are to stay."""
    text = F.concat(F.lit('```JSON\n{"a": "\\d'), "event_type", F.lit('", "b": "'), "event_type", F.lit(' \\"x\\""}\n```'))
    return t.events.select("event_id", F.from_json(X.repaired_json(text), "a string, b string").alias("p")).select("event_id", "p.a", "p.b")


@query("repair_rows", "SELECT o_orderkey::VARCHAR AS doc, o_orderkey % 4 < 2 OR o_orderkey % 8 = 2 AS good FROM orders")
def repair_rows(t):
    rows = build.extracted(responses(t))
    again = build.bad_rows(rows).where("pos % 8 = 2").withColumn("response", F.lit('{"nodes":[],"edges":[]}'))
    out = build.repaired(rows, build.extracted(again.drop("entity_layer")))
    return out.select("doc", F.col("entity_layer").isNotNull().alias("good"))


def built(t):
    return build.single_pass(build.extracted(responses(t)).select("doc", "pos", "text", "entity_layer"))


@query("single_pass_build", """SELECT 'edge:' || o_orderkey || ':0' AS edge_id, 'node:' || o_orderkey || ':1' AS source_node_id, 'node:' || o_orderkey || ':0' AS target_node_id, o_orderdate::DATE::VARCHAR AS start FROM orders WHERE o_orderkey % 4 < 2""")
def single_pass_build(t):
    return built(t).edges.select("edge_id", "source_node_id", "target_node_id", "valid_time.start")


@query("paragraph_graph", """SELECT 'sent:' || o_orderkey || ':0' AS sentence_id, 'Order ' || o_orderkey || ' was placed.' AS text, 'node:' || o_orderkey || ':0' AS nodes FROM orders WHERE o_orderkey % 4 < 2
  UNION ALL SELECT 'sent:' || o_orderkey || ':1', 'Customer ' || o_custkey || ' waits.', 'node:' || o_orderkey || ':1' FROM orders WHERE o_orderkey % 4 < 2""")
def paragraph_graph(t):
    return built(t).sentences.select("sentence_id", "text", F.array_join("node_map", ",").alias("nodes"))


@query("paragraph_graph_aliases", """SELECT 'sent:' || o_orderkey || ':0' AS sentence_id, 'node:' || o_orderkey || ':0' AS nodes FROM orders WHERE o_orderkey % 4 < 2
  UNION ALL SELECT 'sent:' || o_orderkey || ':1', 'node:' || o_orderkey || ':1' FROM orders WHERE o_orderkey % 4 < 2""")
def paragraph_graph_aliases(t):
    """The second sentence has the customer's alias alone."""
    called = F.format_string('"name":"Customer %d","type":["Person"],"description":"","aliases":["Buyer %d","B."]', "o_custkey", "o_custkey")
    plain = F.format_string('"name":"Customer %d","type":["Person"],"description":"","aliases":[]', "o_custkey")
    rows = responses(t).join(t.orders.select(F.col("o_orderkey").cast("string").alias("doc"), "o_custkey"), "doc")
    rows = rows.withColumns({"response": F.replace("response", plain, called), "text": F.concat(F.lit("Order "), "doc", F.lit(" was placed. The buyer "), "o_custkey", F.lit(" waits."))})
    graph = build.single_pass(build.extracted(rows).select("doc", "pos", "text", "entity_layer"), aliases=True)
    return graph.sentences.select("sentence_id", F.array_join("node_map", ",").alias("nodes"))


@query("extraction_row_filters", """WITH e AS (SELECT l_suppkey AS s, l_suppkey % 10 AS d FROM lineitem) SELECT s, d, count(*) AS n FROM e WHERE s <> d AND d IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY ALL""")
def extraction_row_filters(t):
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") % 10).alias("dst")).where("src <> dst")
    every, even = t.supplier.select(F.col("s_suppkey").alias("id")), t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("dst"))
    kept = resolve.without_dangling(edges, every).join(even, "dst", "left_semi")
    return kept.groupBy(F.col("src").alias("s"), F.col("dst").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("sentences_by_passage", "SELECT l_orderkey AS passage, array_to_string(list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_partkey), ',') AS sentences FROM lineitem GROUP BY l_orderkey")
def sentences_by_passage(t):
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("passage")).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["l_linenumber"], F.lit(":"), x["l_partkey"])), ",").alias("sentences"))


@query("entity_descriptions", f"WITH {kg.PARTS} SELECT id, '[' || array_to_string(type, ',') || ']: ' || name AS description FROM parts")
def entity_descriptions(t):
    return kg.parts(t).select("id", X.entity_description("type", "name").alias("description"))


@query("paragraph_text", "SELECT n_nationkey AS k, 'Title:' || n_name || chr(10) || 'Content:' || r_name AS paragraph FROM nation JOIN region ON n_regionkey = r_regionkey")
def paragraph_text(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_nationkey").alias("k"), X.paragraph("n_name", "r_name").alias("paragraph"))


@query("llm_node_view", f"WITH {kg.PARTS}, {kg.PLACES} SELECT id, name AS entity, array_to_string(type, ',') AS types, left(description, 200) || '...' AS description, array_to_string(aliases, ',') AS aliases FROM parts")
def llm_node_view(t):
    """Parts have aliases and are shown, places have none."""
    nodes = kg.parts(t).unionByName(kg.places(t))
    shown = nodes.withColumn("v", X.node_view("name", "type", "description", "aliases")).where("v IS NOT NULL")
    return shown.select("id", "v.entity", F.array_join("v.types", ",").alias("types"), "v.description", F.array_join("v.aliases", ",").alias("aliases"))


@query("dataset_semijoin_first3", """WITH q AS (SELECT o_custkey AS question, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT question, k AS context FROM q WHERE r <= 3 AND question IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def dataset_semijoin_first3(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("question")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("temporal_data"))
    valid = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("question"))
    return rows.join(valid, "question", "left_semi").select("question", F.explode(F.slice("temporal_data", 1, 3)).alias("context"))


@query("answers_overlap_year", """WITH a AS (SELECT o_custkey AS c, list_distinct(list(year(o_orderdate))) AS ys FROM orders GROUP BY 1) SELECT c, len(list_intersect(ys, [1997, 1998]))::BIGINT AS matched FROM a WHERE len(list_intersect(ys, [1997, 1998])) > 0""")
def answers_overlap_year(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("c")).agg(F.collect_set(F.year("o_orderdate")).alias("ys"))
    wanted = F.array(F.lit(1997), F.lit(1998))
    return rows.where(F.arrays_overlap("ys", wanted)).select("c", F.size(F.array_intersect("ys", wanted)).cast("long").alias("matched"))


def answers(t):
    """Turns against the turn before of the same conversation, as prediction and truth."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("prediction"), F.coalesce(before, F.lit("")).alias("truth"))


#: Articles are words of their own once punctuation is gone.
NORMAL = r"""array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '[ \t\n\r\f]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"""
ANSWERS = f"""an AS (SELECT conv_id, turn, text AS prediction, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS truth FROM conversations), nm AS MATERIALIZED (SELECT *, row_number() OVER () AS row, {NORMAL.format("prediction")} AS np, {NORMAL.format("truth")} AS nt FROM an),
  tk AS MATERIALIZED (SELECT *, list_filter(string_split(np, ' '), lambda w: w <> '') AS a, list_filter(string_split(nt, ' '), lambda w: w <> '') AS b FROM nm),
  sm AS (SELECT row, sum(least(x, y)) AS same FROM (SELECT row, w, count(*) AS x FROM (SELECT row, unnest(a) AS w FROM tk) GROUP BY ALL) JOIN (SELECT row, w, count(*) AS y FROM (SELECT row, unnest(b) AS w FROM tk) GROUP BY ALL) USING (row, w) GROUP BY row),
  f AS (SELECT conv_id, turn, np, nt, prediction, truth, CASE WHEN same > 0 THEN 2.0::DOUBLE * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)) ELSE 0 END AS f1, np = nt AS em FROM tk LEFT JOIN sm USING (row))"""


@query("answer_normalise", f"WITH {ANSWERS} SELECT conv_id, turn, np AS answer FROM f")
def answer_normalise(t):
    return answers(t).select("conv_id", "turn", X.normal_answer("prediction").alias("answer"))


@query("token_f1", f"WITH {ANSWERS} SELECT conv_id, turn, round(f1, 9) AS f1 FROM f")
def token_f1(t):
    return answers(t).select("conv_id", "turn", F.round(evaluate.token_f1("prediction", "truth"), 9).alias("f1"))


@query("exact_match", f"WITH {ANSWERS} SELECT conv_id, turn, em FROM f")
def exact_match(t):
    return answers(t).select("conv_id", "turn", evaluate.exact_match("prediction", "truth").alias("em"))


@query("containment_match", f"WITH {ANSWERS} SELECT conv_id, turn, contains(lower(prediction), lower(truth)) OR contains(lower(truth), lower(prediction)) AS has_match FROM f")
def containment_match(t):
    return answers(t).select("conv_id", "turn", evaluate.contains_match("prediction", F.array("truth")).alias("has_match"))


@query("qa_metrics", f"""WITH {ANSWERS}, v AS (SELECT *, contains(lower(prediction), lower(truth)) OR contains(lower(truth), lower(prediction)) OR f1 > 0.5 AS predict FROM f WHERE conv_id % 10 <> 0)
  SELECT count(*) AS rows, round(100 * avg(predict::INT), 4) AS accuracy, round(100 * avg(f1), 4) AS f1, round(100 * avg(em::INT), 4) AS em FROM v""")
def qa_metrics(t):
    rows = answers(t).withColumns({"f1": evaluate.token_f1("prediction", "truth"), "em": evaluate.exact_match("prediction", "truth"), "has_answer_match": evaluate.contains_match("prediction", F.array("truth")), "error": F.when(F.col("conv_id") % 10 == 0, "failed")})
    return evaluate.metrics(evaluate.judged(rows.withColumn("predict", F.col("f1") > 0.5)))


@query("error_and_incorrect_rows", "SELECT role, count_if(conv_id % 10 = 0) AS failed, count_if(conv_id % 10 <> 0 AND turn % 2 = 1) AS incorrect FROM conversations GROUP BY role")
def error_and_incorrect_rows(t):
    rows = t.conversations.withColumns({"error": F.when(F.col("conv_id") % 10 == 0, "failed"), "predict": F.col("turn") % 2 == 0})
    return rows.groupBy("role").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull() & ~F.col("predict")).alias("incorrect"))


@query("token_usage_sums", r"SELECT role, sum(len(regexp_extract_all(coalesce(text, ''), '\S+')))::BIGINT AS tokens, count(*) AS calls FROM conversations GROUP BY role")
def token_usage_sums(t):
    return t.conversations.groupBy("role").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))).cast("long").alias("tokens"), F.count(F.lit(1)).alias("calls"))


@query("distinct_answers", "SELECT source, count(DISTINCT lower(trim(text))) AS n FROM documents GROUP BY source")
def distinct_answers(t):
    return evaluate.distinct_answers(t.documents, "source", "text")


@query("event_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_window_counts(t):
    from ..streaming.ingest import windowed_counts

    return windowed_counts(t.events).select("start", "event_type", "n")
