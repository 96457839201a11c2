"""Unit tests of the core operators on small hand-computed tables."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.operators import bm25, build, dense, evaluate, fusion, graph, plugins, resolve
from tessera.plans import retrieval
from tessera.sources import files, stages

OPEN = [("2", "2001", None), ("3", "2001", "2009"), ("4", "1990-01-01", "1995-12-31"), ("5", "2005", "2005"), ("1", None, None), ("6", "bad", "bad")]


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_overlap_follows_the_time_rules(spark):
    df = spark.createDataFrame(OPEN, "id string, start string, end string")
    at = lambda a, b: {r[0] for r in df.where(T.overlaps("start", "end", F.lit(a), F.lit(b).cast("string"))).select("id").collect()}
    assert at("2009-06-01", "2009-06-30") == {"1", "2"}
    assert at("1980", "1981") == {"1"}
    assert at("2005", None) == {"1", "2", "3", "5"}


def test_filter_falls_back_to_all(spark):
    df = spark.createDataFrame([(1, *r) for r in OPEN if r[0] in "35"], "q int, id string, start string, end string")
    assert graph.time_filter(df, ["q"], "start", "end", F.lit("1980"), F.lit("1981")).count() == 2
    assert graph.time_filter(df, ["q"], "start", "end", F.lit("2008"), F.lit("2008")).count() == 1


def test_decay_expand_and_extract(spark):
    df = spark.createDataFrame([("From 2004 to 2005 and 2010", "2004/02"), ("on 12/05/19", "2000"), ("none", "")], "text string, stamp string")
    got = df.select(T.query_interval("text").alias("i"), T.expand("stamp").alias("e")).collect()
    assert [tuple(r.i) for r in got] == [("2004-01-01", "2005-12-31"), ("2019-12-05", "2019-12-05"), ("2025-01-01", "2025-12-31")]
    assert [r.e and tuple(r.e) for r in got] == [("2004-02-01", "2004-02-29"), ("2000-01-01", "2000-12-31"), None]
    one = spark.range(1).select(T.decay(F.lit("2000"), F.lit("2002"), F.lit(2006.0)).alias("a"), T.decay(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(2006.0)).alias("b")).first()
    assert one.a == pytest.approx(math.exp(-(5**2) / 50)) and one.b == 0.5


def test_text_functions(spark):
    one = spark.range(1).select(
        X.sentences(F.lit(" A b. C d!  E")).alias("s"), X.fixed_chunks(F.lit("a b c d e"), 3, 1).alias("c"), X.tokens(F.lit("Süd-College, 2!")).alias("t"),
        X.budget_chunks(F.array(*map(F.lit, ("a b", "c d", "e f g h i"))), None, 6, 1).alias("b"), X.normal_answer(F.lit("The  Answer, is a B.")).alias("n"),
        X.repaired_json(F.lit('```json\n{"a": "\\d"}\n```')).alias("j"), X.intent(F.lit("Who came first?")).alias("i"),
    ).first()
    assert one.s == ["A b.", "C d!", "E"] and one.c == ["a b c", "c d e", "e"] and one.t == ["sud", "college", "2"]
    assert one.b == ["a b", "c d", "e f g h i"] and one.n == "answer is b" and one.j == '{"a": "d"}' and one.i == "ordering"


def test_pagerank_keeps_mass_and_both_paths_agree(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 2.0), (2, "a", "c", 1.0)], "question_id int, lo string, hi string, w double")
    nodes = spark.createDataFrame([(q, n) for q in (1, 2) for n in "abcd"], "question_id int, node string")
    seeds = spark.createDataFrame([(1, "a"), (1, "d"), (2, "a")], "question_id int, node string")
    joined = graph.ppr(graph.arcs(pairs, "w"), nodes, seeds, iterations=8)
    grouped = graph.ppr_grouped(graph.arcs(pairs, "w"), nodes, seeds, iterations=8, tolerance=0)
    a, b = ({(r.question_id, r.node): r.score for r in df.collect()} for df in (joined, grouped))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    assert sum(v for (q, _), v in a.items() if q == 1) == pytest.approx(1.0)
    none = graph.ppr_grouped(graph.arcs(pairs, "w"), nodes, seeds.where("question_id = 1"))
    assert {r.score for r in none.where("question_id = 2").collect()} == {1.0}


def test_simple_graph_ball_and_components(spark):
    edges = spark.createDataFrame([("1", "2", 1, "a"), ("2", "1", 2, "b"), ("1", "3", 3, "c")], "src string, dst string, pos int, rel string")
    pairs = graph.simple(edges)
    assert rows(pairs, "lo", "hi", "rel") == [("1", "2", "b"), ("1", "3", "c")]
    seeds = spark.createDataFrame([(1, "2")], "question_id int, node string")
    assert rows(graph.ball(pairs, seeds, 1), "node") == [("1",), ("2",)]
    assert rows(graph.ball(pairs, seeds, 2), "node") == [("1",), ("2",), ("3",)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20], "a long, b long")
    for few in (0, 100):
        assert {r.node: r.component for r in graph.components(chain, few).collect()} == {k: 0 if k < 21 else 21 for k in range(41)}


def test_fusion(spark):
    one = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "question_id int, item string, rnk int")
    two = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "question_id int, item string, rnk int")
    assert [(r[0], r[1]) for r in fusion.rrf_sum([one, two]).orderBy("rnk").select("item", "rnk").collect()] == [("y", 1), ("x", 2), ("z", 3)]
    assert fusion.top_overlap(one, two).first().jaccard == pytest.approx(1 / 3)
    assert [r.item for r in fusion.ordered_union(one, two).orderBy("rnk").collect()] == ["x", "y", "z"]
    text = spark.createDataFrame([(1, "p", 1), (1, "q", 2)], "question_id int, item string, rnk int")
    assert retrieval.final_passages(one, text).first().passages == ["p", "q", "x", "y"]


def test_merge_is_idempotent_and_rewires(spark):
    nodes = spark.createDataFrame(
        [("1", 1, "Ada", ["Person"], ["A"], "x"), ("4", 4, "Ada", ["Person", "Author"], None, "y"), ("2", 2, "Nord", ["Org"], None, "")],
        "id string, pos int, name string, type array<string>, aliases array<string>, description string",
    )
    mapping = stages.written(resolve.align_exact(nodes), "m")
    merged = resolve.merge_nodes(nodes, mapping)
    got = {r.id: (sorted(r.type), r.aliases, r.description) for r in merged.collect()}
    assert got == {"1": (["Author", "Person"], ["A"], "x\ny"), "2": (["Org"], [], "")}
    assert resolve.align_exact(merged).count() == 0
    edges = spark.createDataFrame([("4", "4", "self", 1), ("4", "2", "at", 2), ("1", "2", "at", 3)], "src string, dst string, relation string, pos int")
    assert rows(resolve.rewired(edges, mapping), "src", "dst", "relation", "pos") == [("1", "2", "at", 2)]


def test_bm25_matches_the_formula(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c d"), (4, "e")], "doc int, text string")
    asked = spark.createDataFrame([(1, "a d")], "question_id int, text string")
    got = {r.doc: r.score for r in bm25.scores(bm25.build(docs), asked).collect()}
    idf = math.log(4 - 1 + 0.5) - math.log(1.5)
    avg = 9 / 4
    assert got == {1: pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))), 3: pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg)))}
    assert bm25.full_ranking(bm25.scores(bm25.build(docs), asked), asked, docs).count() == 4


def test_vectors(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 0.0])], "chunk int, doc int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "question_id int, query array<float>")
    assert rows(dense.by_document(dense.distances(v, q)), "doc", "dist") == [(1, 2.0), (2, 0.0)]
    assert rows(resolve.near_pairs(v.select(F.col("chunk").alias("id"), "embedding"), 0.5)) == [(1, 3)]


def test_construction_and_repair(spark):
    good = '```json\n{"nodes":[{"id":"n","name":"Ada","valid_time":{"start":"2001","end":""}},{"id":"m","name":"Nord"}],"edges":[{"source_node_id":"n","target_node_id":"m","relationship_name":"at"},{"source_node_id":"n","target_node_id":"zz","relationship_name":"lost"}]}\n```'
    docs = spark.createDataFrame([("a", 1, "Ada met. Nord slept.", good), ("b", 2, "x", "no json"), ("c", 3, "", good)], "doc string, pos int, text string, response string")
    layer = build.extracted(docs)
    assert build.bad_rows(layer).count() == 1
    g = build.single_pass(layer)
    assert g.edges.count() == 1 and g.passages.count() == 1
    assert {r.name: r.valid_time.start for r in g.nodes.collect()} == {"Ada": "2001", "Nord": "2001"}
    assert [r.node_map for r in g.sentences.orderBy("sentence_id").collect()] == [["node:a:0"], ["node:a:1"]]


def test_plugins(spark):
    def model(system, user, schema):
        if user == "bad":
            raise ValueError("no")
        return user.upper(), 1, 2

    asked = spark.createDataFrame([("1", "s", "hi"), ("2", "s", "bad")], "id string, system string, user string")
    out = {r.id: (r.response, r.error) for r in plugins.call(asked, model).collect()}
    assert out == {"1": ("HI", None), "2": (None, "no")}
    q = spark.createDataFrame([("hi",)], "question string")
    assert plugins.augmented(q, model).where("NOT augmentation_failed AND question = 'HI'").count() == 5
    assert plugins.embed(q.withColumnRenamed("question", "text"), lambda xs: [[1.0] for _ in xs]).first().embedding == [1.0]


def test_evaluation(spark):
    one = spark.range(1).select(
        evaluate.token_f1(F.lit("the cat sat"), F.lit("cat sat down")).alias("f1"), evaluate.token_f1(F.lit(""), F.lit("x")).alias("zero"),
        evaluate.exact_match(F.lit("The Cat."), F.lit("cat")).alias("em"), evaluate.contains_match(F.lit(""), F.array(F.lit("x"))).alias("c"),
    ).first()
    assert one.f1 == pytest.approx(0.8) and one.zero == 0 and one.em and one.c


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "qa.json").write_text('[{"question": "q", "answer": "a"}, {"question": "r", "answer": ["b", "c"]}]')
    assert [r.answer for r in files.questions(spark, str(tmp_path / "qa.json")).collect()] == [["a"], ["b", "c"]]
    (tmp_path / "g.json").write_text('{"entity_layer": {"nodes": [{"id": "1", "name": "Ada", "type": ["P"]}], "edges": []}, "passage_layer": {"passages": []}, "sentence_layer": {"sentences": []}}')
    g = files.read_graph(spark, str(tmp_path / "g.json"))
    assert g.nodes.first().name == "Ada" and g.edges.count() == 0
    files.write_graph(g, str(tmp_path / "g"))
    assert files.load_graph(spark, str(tmp_path / "g")).nodes.count() == 1
    made = []
    for _ in range(2):
        stages.stage(spark, str(tmp_path / "s"), lambda: made.append(1) or spark.range(3)).count()
    assert made == [1]


def test_stream_counts(spark, tmp_path):
    from tessera.streaming import ingest

    rows_ = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value, 1L AS event_id UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a', 2.0D, 2L")
    rows_.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows_.schema).parquet(str(tmp_path / "in"))
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert ingest.windowed_counts(rows_).first().n == 2


def test_long_labels_and_names_link(spark):
    long = [" ".join(f"w{k}" for k in range(n)) for n in (7, 9, 15)]
    texts = spark.createDataFrame([(1, f"x {long[2]} y. {long[1]}"), (2, long[0]), (3, "w0")], "text_id int, text string")
    labels = spark.createDataFrame([(x, k) for k, x in enumerate(long)], "label string, id int")
    assert sorted(map(tuple, resolve.link_labels(texts, labels).collect())) == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 1)]
    asked = texts.withColumnsRenamed({"text_id": "question_id", "text": "question"})
    names = labels.withColumnsRenamed({"label": "name", "id": "node"})
    assert sorted(map(tuple, retrieval.keyword_seeds(asked, names, every=True).collect())) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    # The short name within the long ones is covered by them.
    assert sorted(map(tuple, retrieval.keyword_seeds(asked, names).collect())) == [(1, 1), (1, 2), (2, 0)]
    assert retrieval.keyword_seeds(asked, names.limit(0)).count() == 0


def test_merge_keeps_every_column_of_the_base(spark):
    nodes = spark.createDataFrame(
        [("4", 1, "Ada", ["P"], None, "y", {"k": "4", "b": "4"}, ("1990", None), True), ("1", 2, "Ada", ["P"], ["A"], "x", {"k": "1", "a": "1"}, ("2001", "2002"), False), ("9", 3, "Bo", ["P"], None, None, None, None, None)],
        "id string, pos int, name string, type array<string>, aliases array<string>, description string, properties map<string,string>, valid_time struct<start:string,end:string>, is_temporal_entity boolean",
    )
    got = {r.id: r for r in resolve.merge_nodes(nodes, stages.written(resolve.align_exact(nodes), "m")).collect()}
    one = got["1"]
    assert (one.pos, tuple(one.valid_time), one.is_temporal_entity, one.properties, one.description) == (1, ("2001", "2002"), False, {"k": "1", "a": "1", "b": "4"}, "x\ny")
    assert got["9"].properties is None and got["9"].aliases == []


def test_merge_of_many_members_is_not_quadratic(spark):
    """One base of 20,000 members, with a property of each and one that all have."""
    import time

    k = F.col("pos")
    nodes = spark.range(20_000).select(F.format_string("%05d", "id").alias("id"), F.col("id").alias("pos"), F.lit("n").alias("name"), F.array(F.lit("T")).alias("type"), F.lit(None).cast("array<string>").alias("aliases"), F.lit("").alias("description"))
    nodes = nodes.withColumn("properties", F.create_map(F.lit("kept"), k.cast("string"), F.concat(F.lit("own"), k), F.lit("x")))
    mapping = nodes.select(F.col("id").alias("member"), F.lit("00000").alias("base"))
    began = time.time()
    one = resolve.merge_nodes(nodes, mapping).select(F.size(F.map_keys("properties")).alias("n"), F.col("properties")["kept"].alias("kept"), F.map_keys("properties")[2].alias("third")).collect()
    assert [tuple(r) for r in one] == [(20_001, "0", "own1")] and time.time() - began < 60


def test_merge_counts_null_types_as_empty(spark):
    nodes = spark.createDataFrame([("1", 1, "Ada", None, None, "x"), ("2", 2, "Ada", ["T"], None, "y"), ("3", 3, "Bo", None, None, None)], "id string, pos int, name string, type array<string>, aliases array<string>, description string")
    mapping = spark.createDataFrame([("2", "1")], "member string, base string")
    assert {r.id: r.type for r in resolve.merge_nodes(nodes, mapping).collect()} == {"1": ["T"], "3": []}


def test_staged_ids_may_hold_colons_and_extraction_needs_a_model(spark, tmp_path, capsys):
    from tessera.plans import staged

    docs = spark.createDataFrame([("http://x:1", 1, "Ada met Bob."), ("http://x:1:2", 2, "Bob saw Cy.")], "doc string, pos int, text string")
    rows_ = staged.extract(spark, docs, str(tmp_path), fake_model)
    got = staged.align(spark, rows_, str(tmp_path))
    assert {"Ada", "Bob", "Cy"} <= {r.name for r in got["nodes"].collect()}
    with pytest.raises(SystemExit):
        staged.main(["--documents", "docs.json", "--out", str(tmp_path)])
    assert "--model" in capsys.readouterr().err


def test_graphs_with_equal_ids_stay_apart(spark):
    nodes = [spark.createDataFrame([("1", x)], "id string, name string") for x in ("a", "b")]
    edge = "src string, dst string, relation string, pos long"
    edges = [spark.createDataFrame([("1", "2", "r", 1), ("1", "2", "r", 2), ("1", "1", "r", 3)], edge), spark.createDataFrame([("1", "2", "r", 1)], edge)]
    every, joined = resolve.combined_graph(nodes, edges)
    assert rows(every, "id", "name") == [("0:1", "a"), ("1:1", "b")] and rows(joined, "src", "dst") == [("0:1", "0:2"), ("1:1", "1:2")]
    pairs = spark.createDataFrame([("x", "y", "r", 2), ("y", "x", "r", 1), ("y", "x", "s", 3)], "source string, target string, relation string, pos int")
    assert rows(resolve.distinct_undirected(pairs), "source", "relation") == [("y", "r"), ("y", "s")]


def test_pagerank_stops_at_its_tolerance_and_counts_isolated_nodes(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 2.0), (1, "c", "d", 1.0)], "question_id int, lo string, hi string, w double")
    nodes = spark.createDataFrame([(1, n) for n in "abcd"], "question_id int, node string")
    apart = spark.createDataFrame([(1, n) for n in "xyz"], "question_id int, node string")
    seeds = spark.createDataFrame([(1, "a")], "question_id int, node string")
    arcs = graph.arcs(pairs, "w")
    exact = {r.node: r.score for r in graph.ppr_grouped(arcs, nodes, seeds, iterations=500, tolerance=0).collect()}
    close = {r.node: r.score for r in graph.ppr_grouped(arcs, nodes, seeds).collect()}
    joined = {r.node: r.score for r in graph.ppr(arcs, nodes, seeds).collect()}
    assert all(close[n] == pytest.approx(exact[n], abs=1e-5) and joined[n] == pytest.approx(exact[n], abs=1e-5) for n in "abcd")
    counted = apart.groupBy("question_id").agg(F.count("node").alias("n"))
    listed = {r.node: r.score for r in graph.ppr_grouped(arcs, nodes.union(apart), seeds, iterations=7, tolerance=0).collect()}
    short = {r.node: r.score for r in graph.ppr_grouped(arcs, nodes, seeds, iterations=7, tolerance=0, isolated=counted).collect()}
    assert all(short[n] == pytest.approx(listed[n], abs=1e-12) for n in "abcd") and listed["x"] == 0


def test_passages_of_the_text_ranking_alone_can_win(spark):
    members = spark.createDataFrame([(1, "a")], "question_id int, node string")
    pairs = spark.createDataFrame([], "question_id int, lo string, hi string, w double")
    bridge = spark.createDataFrame([("p1", "a"), ("p2", "b")], "passage string, node string")
    passages = spark.createDataFrame([(f"p{k}", None, None) for k in range(1, 5)], "passage string, start string, end string")
    asked = spark.createDataFrame([(1, "2000", "2001")], "question_id int, q_start string, q_end string")
    text = spark.createDataFrame([(1, "p4", 1), (1, "p1", 2)], "question_id int, item string, rnk int")
    out = retrieval.ranked_passages(members, pairs, members, bridge, passages, asked, text)
    assert {r.item for r in out.collect()} == {"p1", "p4"}


def test_names_within_questions(spark):
    q = spark.createDataFrame([(1, "Who met Anna van Dyck-Meer in Oslo?"), (2, "xOslo")], "question_id int, question string")
    names = spark.createDataFrame([("1", "Anna van Dyck"), ("2", "Oslo"), ("3", "oslo"), ("4", "van Dyck-Meer in Oslo?"), ("5", "An")], "node string, name string")
    assert rows(retrieval.entity_names(q, names), "question_id", "node") == [(1, "1"), (1, "2"), (1, "4"), (1, "5"), (2, "2")]
    asked = spark.createDataFrame([(1, "ÖSLO"), (1, "nobody")], "question_id int, name string")
    assert rows(retrieval.resolved_names(asked, names), "node") == [("2",), ("3",)]


def test_index_finds_nine_of_ten(spark):
    from tessera.plans import retrieval_queries as R
    from tessera.plans.kg import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    true = {(r.question_id, r.doc) for r in dense.ranked(dense.distances(R.whole(t), R.vectors(t)), 10).collect()}
    found = {(r.question_id, r.doc) for r in R.ivf_probe_topk(t).collect()}
    assert len(true) == 50 and len(true & found) / len(true) >= 0.9
    few = dense.distances(R.whole(t), R.vectors(t), most_queries=2)
    assert {(r.question_id, r.doc) for r in dense.ranked(few, 10).collect()} == true


def test_texts_in_other_scripts_and_odd_json(spark):
    one = spark.range(1).select(X.tokens(F.lit("Łódź, Straße; Привет-мир 漢字")).alias("t"), X.repaired_json(F.lit('```yaml\n{"a": "\\d \\u0041 \\n"}\n```')).alias("j"), X.node_view(F.lit("n"), F.array(F.lit("T")), F.lit("d" * 300), F.array(F.lit("a"))).alias("v")).first()
    assert one.t == ["lodz", "strasse", "privet", "mir", "漢字"] and one.j == '{"a": "d \\u0041 \\n"}' and len(one.v.description) == 203


def test_config_and_timer(tmp_path):
    from tessera.config import Config

    (tmp_path / "c.yaml").write_text("# settings\nretrieval:\n  ppr_alpha: 0.5\n  damping: 0.9  # less\n  snapshot_strictness: False\n  intent_weights:\n    ordering: [1, 2, 3]\nsigma: 2.5\n")
    got = Config.read(str(tmp_path / "c.yaml"))
    assert (got.damping, got.snapshot_strictness, got.sigma, got.intent_weights["ordering"], got.intent_weights["atemporal"]) == (0.9, False, 2.5, (1, 2, 3), (0.5, 2.0, 0.1))
    timer = evaluate.Timer()
    with timer("x"):
        pass
    assert timer.seconds["x"] >= 0


def fake_model(system, user, schema):
    """Answers every kind of prompt by a rule."""
    import json
    import re

    if "Extract" in system:
        if "broken" in user:
            return "no json", 1, 1
        names = re.findall(r"[A-Z][a-z]+", user)
        nodes = [{"id": str(k), "name": n, "type": ["T"], "aliases": ["the " + n], "valid_time": {"start": "2001", "end": ""}} for k, n in enumerate(names)]
        edges = [{"source_node_id": "0", "target_node_id": str(k), "relationship_name": "near"} for k in range(1, len(names))]
        return "```json\n" + json.dumps({"nodes": nodes, "edges": edges}) + "\n```", 10, 5
    if "same" in system:
        ids = sorted(e["id"] for e in json.loads(user))
        return json.dumps({"merge_instruction": [{"base_node_id": ids[0], "merge_node_ids": ids[1:2]}]}), 1, 1
    if "related" in system:
        ids = sorted(e["id"] for e in json.loads(user))
        return json.dumps({"relation_predictions": [{"entity_1_id": a, "entity_2_id": b} for a, b in zip(ids, ids[1:])] + [{"entity_1_id": ids[0], "entity_2_id": "999"}]}), 1, 1
    if "Name the listed" in system:
        return '{"entity_appeared_in_query": ["$$Ada$$", ""]}', 1, 1
    if "Answer from" in system:
        return '{"answer": "42", "evidence": "e"}', 1, 1
    if "shortest span" in system:
        return "", 1, 1
    return '{"explain": "x", "predict": true}' if "yes" in user else "unreadable", 1, 1


def test_staged_build(spark, tmp_path):
    from tessera.plans import staged

    docs = spark.createDataFrame([("a", 1, "Ada met Bob. Then Ada slept."), ("b", 2, "Bob saw Cy and Di."), ("c", 3, "broken")], "doc string, pos int, text string")
    out, calls = str(tmp_path), []
    rows_ = staged.extract(spark, docs, out, fake_model, at_once=4)
    assert build.bad_rows(rows_).count() == 1 and spark.read.parquet(f"{out}/usage").first().prompt_tokens == 21
    fixed = staged.repair(spark, out, lambda s, u, x: fake_model(s, "Eve", x))
    assert build.bad_rows(fixed).count() == 0 and fixed.count() == 3

    def embedder(texts):
        calls.append(len(texts))
        return [[1.0, 0.0] if x[-3:] in (" Cy", " Di") else [0.0, 1.0 if x.endswith("Ada") else -1.0] for x in texts]

    for _ in range(2):  # the second run only reads
        got = staged.align(spark, fixed, out, embedder, fake_model, eps=0.1)
    names = {r.name: r.id for r in got["nodes"].collect()}
    assert set(names) >= {"Ada", "Bob"} and len(names) == got["nodes"].count() and sorted(map(int, names.values())) == list(range(1, len(names) + 1))
    ends = {(r.src, r.dst) for r in got["edges"].collect()}
    assert all(a in names.values() and b in names.values() and a != b for a, b in ends)
    sentences = {r.sentence_id: r.text for r in got["sentences"].collect()}
    linked = {(sentences[r.text_id], r.id) for r in got["links"].collect()}
    assert ("Then Ada slept.", names["Ada"]) in linked and ("Ada met Bob.", names["Bob"]) in linked
    assert staged.embed(spark, docs, out, lambda xs: [[0.0, 1.0]] * len(xs)).count() == 3


def test_contracts_with_models(spark):
    q = spark.createDataFrame([(1, "Who is Ada?")], "question_id int, question string")
    listed = spark.createDataFrame([(1, 1, "Name: $$Ada$$")], "question_id int, rnk int, ontology string")
    assert rows(plugins.linked_entities(q, listed, fake_model), "name") == [("Ada",)]
    names = spark.createDataFrame([("n", "ada"), ("m", "Bob")], "node string, name string")
    assert rows(plugins.linked_entities(q, listed, None, names), "name") == [("ada",)]
    asked = spark.createDataFrame([("x", ["p"], "g", "yes"), ("y", [], "g", "no")], "question string, passages array<string>, groundtruth string, prediction string")
    assert {r.prediction for r in plugins.answered(asked.drop("prediction"), fake_model).collect()} == {"42"}
    assert [r.llm_evaluation.predict for r in plugins.judged(asked, fake_model).orderBy("question").collect()] == [True, False]
    assert [r.short_answer for r in plugins.short_answers(asked, fake_model, at_once=2).orderBy("question").collect()] == ["yes", "no"]
    tried = []

    def flaky(system, user, schema):
        tried.append(1)
        if len(tried) < 2:
            raise ValueError("busy")
        return "ok", 1, 1

    assert plugins.call(asked.limit(1).selectExpr("question AS system", "question AS user"), flaky, retries=1, pause=0.01).first().response == "ok"
