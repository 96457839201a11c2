"""Ranks without whole rankings, against sorted lists."""

import random

from pyspark.sql import functions as F

from tessera.operators import bm25, dense, fusion


def test_places_against_a_count(spark):
    random.seed(1)
    rows = [(random.choice([1, 1, 1, 2, 3]), (float(random.randrange(30)), random.randrange(9))) for _ in range(3000)]
    wanted = [(random.choice([1, 2, 4]), (float(random.randrange(-1, 32)), random.randrange(9))) for _ in range(200)]
    schema = "question_id int, key struct<s:double,d:int>"
    want = sorted({(q, k, sum(1 for p, x in rows if p == q and x < k)) for q, k in wanted})
    whole = fusion.CHUNK, fusion.FEW
    try:
        for fusion.CHUNK, fusion.FEW in (whole, (50, 40)):
            got = fusion.places(spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(wanted, schema))
            assert sorted((r[0], tuple(r[1]), r[2]) for r in got.collect()) == want
    finally:
        fusion.CHUNK, fusion.FEW = whole
    none = spark.createDataFrame([], schema)
    assert fusion.places(none, spark.createDataFrame(wanted, schema)).agg(F.max("before")).first()[0] == 0
    assert fusion.places(spark.createDataFrame(rows, schema), none).collect() == []


def test_many_wanted_places_do_not_pass_the_driver(spark, monkeypatch):
    """Beyond FEW nothing is sent to tasks; names as keys, questions that span ranges, questions without rows."""
    random.seed(6)
    rows = [(random.choice("aab"), (random.randrange(2), f"d{random.randrange(900):03}")) for _ in range(3000)]
    wanted = [(random.choice("abc"), (random.randrange(2), f"d{random.randrange(900):03}")) for _ in range(500)]
    schema = "question_id string, key struct<k:int,d:string>"
    monkeypatch.setattr(fusion, "FEW", 40)
    monkeypatch.setattr(fusion, "_places", None)
    got = fusion.places(spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(wanted, schema)).collect()
    assert sorted((r[0], tuple(r[1]), r[2]) for r in got) == sorted({(q, k, sum(1 for p, x in rows if p == q and x < k)) for q, k in wanted})


def plain_order(scored, q, docs):
    score = {d: s for p, d, s in scored if p == q}
    return sorted(docs, key=lambda d: (-round(score.get(d, 0.0), 9), d))


def test_ranks_in_the_full_ranking(spark):
    """Scores above, at and below 0, documents without one, and a question without any."""
    random.seed(2)
    docs = [f"d{k:03}" for k in range(200)]
    scored = [(q, d, random.choice([2.5, 1.0, 0.0, -1.0, random.random()])) for q in (1, 2, 3) for d in random.sample(docs, {1: 150, 2: 6, 3: 60}[q])]
    table, asked = spark.createDataFrame(scored, "question_id int, doc string, score double"), spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "question_id int")
    ranking = bm25.ranking(table, asked, spark.createDataFrame([(d,) for d in docs], "doc string"))
    orders = {q: plain_order(scored, q, docs) for q in (1, 2, 3, 4)}
    for k in (1, 20, 500):
        got = {(r["question_id"], r["rnk"]): r["item"] for r in ranking.top(k).collect()}
        assert got == {(q, n + 1): d for q, order in orders.items() for n, d in enumerate(order[:k])}
    wanted = [(q, d) for q in (1, 2, 3, 4) for d in random.sample(docs, 70)]
    got = {(r["question_id"], r["item"]): r["rnk"] for r in ranking.ranks(spark.createDataFrame(wanted, "question_id int, item string")).collect()}
    assert got == {(q, d): orders[q].index(d) + 1 for q, d in wanted}


def test_fused_tops_equal_the_fusion_of_whole_rankings(spark):
    random.seed(3)
    docs = list(range(300))
    scored = spark.createDataFrame([(q, d, random.random()) for q in (1, 2) for d in random.sample(docs, 40)], "question_id int, doc int, score double")
    ids, asked = spark.createDataFrame([(d,) for d in docs], "doc int"), spark.createDataFrame([(1, [0.3, 0.1]), (2, [0.9, 0.9])], "question_id int, query array<double>")
    chunks = spark.createDataFrame([(d, d, [random.random(), random.random()]) for d in docs if d % 3], "chunk int, doc int, embedding array<double>")
    for metric in ("l2", "ip"):
        whole = [bm25.full_ranking(scored, asked, ids), dense.ranked(dense.distances(chunks, asked, metric), descending=metric == "ip")]
        full = fusion.rrf_sum([x.select("question_id", F.col("doc").alias("item"), "rnk") for x in whole])
        few = fusion.rrf_top([bm25.ranking(scored, asked, ids), dense.ranking(chunks, asked, metric)], 25)
        shown = lambda df: sorted((r["question_id"], r["item"], round(r["score"], 12), r["rnk"]) for r in df.collect())
        assert shown(few) == shown(full.where("rnk <= 25"))


def test_rows_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(x,) for x in random.Random(4).sample(range(10_000), 500)], "x int").repartition(7)
    got = fusion.in_order(rows, ["x"]).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(1, 501)) and [r["x"] for r in got] == sorted(r["x"] for r in got)


def test_layers_are_ranked_by_words_and_by_vectors(spark):
    from tessera.plans import retrieval

    asked = spark.createDataFrame([(1, "red fox"), (2, "nothing")], "question_id int, question string")
    sentences = spark.createDataFrame([("a", "the red fox"), ("b", "a fox"), ("c", "blue"), ("d", "green"), ("e", "grey")], "item string, text string")
    triplets = spark.createDataFrame([("t1", "fox|is|red"), ("t2", "sky|is|blue"), ("t3", "sea|is|blue")], "item string, text string")
    vectors = {"triplets": spark.createDataFrame([("t1", [0.0]), ("t2", [5.0]), ("t3", [9.0])], "item string, embedding array<double>")}
    points = spark.createDataFrame([(1, [9.0]), (2, [5.0])], "question_id int, query array<double>")
    got = retrieval.layer_rankings(asked, {"sentences": sentences, "triplets": triplets}, 3, vectors, points)
    listed = lambda df: {q: [r.item for r in sorted(df.collect(), key=lambda r: r.rnk) if r.question_id == q] for q in (1, 2)}
    assert listed(got["sentences"]) == {1: ["a", "b", "c"], 2: ["a", "b", "c"]}
    # 1 + 1/3 is as good as 1/3 + 1: ties go to the ranking by words. Without a word in common that ranking is the ids' order.
    assert listed(got["triplets"]) == {1: ["t1", "t3", "t2"], 2: ["t2", "t1", "t3"]}


def test_contexts_without_time_have_the_graph(spark):
    import json

    from tessera.plans import retrieval

    asked = spark.createDataFrame([(1, "Where is Ada?"), (2, "Nobody")], "question_id int, question string")
    nodes = spark.createDataFrame([("1", "Ada", ["P"], "", ["A."]), ("2", "Bob", ["P"], "", None), ("3", "Cy", ["P"], "", None)], "id string, name string, type array<string>, description string, aliases array<string>")
    edges = spark.createDataFrame([("1", "2", "knows", 1), ("3", "1", "likes", 2), ("2", "3", "far", 3)], "src string, dst string, relation string, pos int")
    bridge = spark.createDataFrame([("p", "1"), ("r", "3")], "passage string, node string")
    hybrid = spark.createDataFrame([(q, x, k + 1) for q in (1, 2) for k, x in enumerate("pqr")], "question_id int, item string, rnk int")
    triplets = spark.createDataFrame([(1, "1", "3", 1), (1, "1", "2", 2)], "question_id int, src string, dst string, rnk int")
    out = retrieval.retrieve_graph(asked, nodes.selectExpr("id AS node", "name"), edges, bridge, hybrid, triplets, nodes=nodes)
    got = {r.question_id: json.loads(r.context) for r in out.collect()}
    assert set(got[1]["relevant_graphs"]) == {"Ada (P) | knows | Bob (P)", "Ada (P) | likes | Cy (P)", "Bob (P) | far | Cy (P)"}
    assert got[1]["relevant_graphs"][0] == "Ada (P) | knows | Bob (P)" and "query_timestamp" not in got[1]
    assert [n["entity"] for n in got[1]["nodes_alias_information"]] == ["Ada"] and set(got[1]["relevant_passages"]) == {"p", "q", "r"}
    assert got[2]["relevant_graphs"] == [] and got[2]["relevant_passages"] == ["r", "q", "p"]


def test_nearest_against_sorted_distances(spark):
    """Ties, copies, null vectors and lengths that differ; blocks smaller than the table; cells; nulls last, as in SQL."""
    random.seed(5)
    rows = [(c, c // 2, None if c % 31 == 0 else [float(random.randrange(3)) for _ in range(2 if c % 29 == 0 else 3)], c % 4) for c in range(300)]
    asked = [(q, None if q == 4 else [1.0, 0.0, 2.0][: 2 if q == 3 else 3]) for q in range(5)]
    table = spark.createDataFrame(rows, "chunk int, doc int, embedding array<float>, cell int").repartition(3)
    questions = spark.createDataFrame(asked, "question_id int, query array<float>")
    chosen = [(q, c) for q in range(5) for c in range(4) if (q + c) % 3]

    def plain(metric, k, cells):
        out = []
        for q, x in asked:
            every = []
            for c, d, v, cell in rows:
                if cells is None or (q, cell) in cells:
                    known = x is not None and v is not None and len(v) == len(x)
                    value = (sum((a - b) ** 2 for a, b in zip(x, v)) if metric == "l2" else -sum(a * b for a, b in zip(x, v))) if known else 0.0
                    every.append((not known, value, d, c))
            out += [(q, c, d, None if lost else abs(s), n + 1) for n, (lost, s, d, c) in enumerate(sorted(every)[:k])]
        return sorted(out)

    whole = dense.ROWS, dense.QUERIES
    try:
        for dense.ROWS, dense.QUERIES in (whole, (7, 2)):
            for metric, k, cells in (("l2", 4, None), ("ip", 4, None), ("l2", 290, None), ("l2", 5, chosen)):
                given = None if cells is None else spark.createDataFrame(cells, "question_id int, cell int")
                got = dense.nearest(table, questions, k, metric, given, most_queries=10 if metric == "l2" else 2)
                assert sorted(tuple(r) for r in got.select("question_id", "chunk", "doc", "dist", "rnk").collect()) == plain(metric, k, cells)
    finally:
        dense.ROWS, dense.QUERIES = whole
    ranked = dense.ranked(dense.distances(table, questions)).where("question_id = 0").orderBy("rnk").collect()
    assert len(ranked) == 300 and ranked[0]["dist"] is not None and ranked[-1]["dist"] is None


def test_ranks_of_all_edges_are_not_made_by_one_window(spark):
    """The only window is that over the ranges' counts."""
    from tessera.plans import graph_queries
    from tessera.plans.kg import Tables

    plan = graph_queries.edge_rank_semantic(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "row_number" not in plan


def test_the_ranking_by_price_is_not_made_by_one_window(spark):
    from tessera.plans import graph_queries
    from tessera.plans.kg import Tables

    ranks = graph_queries.text_rank(Tables(spark, "/root/testdata/sf0.001"))
    assert "row_number" not in ranks._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.rnk for r in ranks.collect()) == list(range(1, ranks.count() + 1))
