"""Dates in words, names in other scripts, and smaller operators."""

from datetime import date

from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.operators import build, fusion, graph, matching, resolve

FORMS = {
    "12 March 2019": (2019, 3, 12), "12 mar 2019": (2019, 3, 12), "3rd of August 1999": (1999, 8, 3), "on the 3rd of August, 1999": (1999, 8, 3), "1 Sept. 2001": (2001, 9, 1),
    "March 12, 2019": (2019, 3, 12), "Mar. 12 2019": (2019, 3, 12), "Tuesday, 12 March 2019": (2019, 3, 12), "Tue 12 March 2019": None, "May 2004": (2004, 5, 1), "in June 2004": (2004, 6, 1),
    "2019/03/12": (2019, 3, 12), "2019.3.12": (2019, 3, 12), "2019-03-12": (2019, 3, 12), "2019-03-12T10:00:00Z": (2019, 3, 12), "2019": (2019, 1, 1), "12/03/2019": (2019, 12, 3), "25/12/2019": (2019, 12, 25),
    "1-2-05": (2005, 1, 2), "1/2/69": (1969, 1, 2), "today": (2024, 2, 29), "Yesterday": (2024, 2, 28), "tomorrow": (2024, 3, 1), "3 days ago": (2024, 2, 26), "a week ago": (2024, 2, 22), "two weeks ago": None,
    "last month": (2024, 1, 29), "next year": (2025, 2, 28), "1 year ago": (2023, 2, 28), "31 February 2019": None, "March 2 19": None, "Mayor 3, 2019": None, "Ma 3, 2019": None, "": None, " 2019 ": (2019, 1, 1), "12 March": None,
}


def test_dates_in_words_and_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in [*FORMS, None]], "x string")
    got = {r[0]: r[1] for r in rows.select("x", T.parse_lenient("x", F.lit("2024-02-29").cast("date"))).collect()}
    assert got == {x: d and date(*d) for x, d in FORMS.items()} | {None: None}
    assert rows.where("x = 'today'").select(T.parse_lenient("x")).first()[0] is None  # without a day that it is relative to


def test_other_scripts_fold_to_latin(spark):
    names = {"Москва": "moskva", "Чайковский": "chaikovskii", "Хрущёв": "khrushchiov", "Αθήνα": "athena", "Ψυχή": "psukhe", "Киї́в": "kiyív", "São Paulo": "sao paulo", "Straße": "strasse", "東京": "東京", "plain": "plain", "объект": "obekt"}
    rows = spark.createDataFrame([(x,) for x in [*names, None]], "x string").select("x", X.fold("x")).collect()
    assert {r[0]: r[1] for r in rows} == names | {None: None}


def test_common_words_are_no_labels(spark):
    texts = spark.createDataFrame([("b a a",), ("a b c",), (None,), ("",)], "text string")
    assert [tuple(r) for r in matching.common_words(texts, 2).collect()] == [("a", 3), ("b", 2)]
    nodes = spark.createDataFrame([(1, 1, "Ab", ["Cd"]), (2, 2, "ab", None), (3, 3, "7", [None])], "id int, pos int, name string, aliases array<string>")
    common = spark.createDataFrame([("cd",)], "label string")
    assert sorted(map(tuple, resolve.label_table(nodes).collect())) == [("ab", 2), ("cd", 1)]
    assert sorted(map(tuple, resolve.label_table(nodes, common).collect())) == [("ab", 2)]


def test_edges_are_ranked_in_their_own_direction(spark):
    triplets = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "a", 2), (1, "c", "d", 3), (1, "b", "a", 4), (1, "e", "f", 5), (2, "b", "a", 9)], "question_id int, src string, dst string, rnk int")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "b", "a"), (1, "e", "f"), (2, "a", "b")], "question_id int, src string, dst string")
    assert sorted(map(tuple, fusion.oriented_edge_rank(triplets, edges).collect())) == [(1, "b", "a", 1), (1, "e", "f", 3)]


def test_reports_of_a_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    bridge = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "a"), ("q", "c"), ("q", "b")], "passage string, node string")
    report = graph.appearance_report(graph.appearances(nodes, bridge), 3).first()
    assert (report.least, report.mean, report.most, [tuple(x) for x in report.top]) == (0, 1.0, 2, [("a", 2), ("b", 1), ("c", 1)])
    assert graph.layer_counts(nodes=nodes, links=bridge).first().asDict() == {"nodes": 4, "links": 5}
    assert graph.appearance_report(graph.appearances(nodes.limit(0), bridge)).first().top == []


def test_a_sentencizer_can_be_given(spark):
    layer = '{"nodes": [{"id": "1", "name": "Ada", "type": [], "description": "", "aliases": ["Countess"], "is_temporal_entity": false, "valid_time": {"start": "", "end": ""}}], "edges": []}'
    docs = build.extracted(spark.createDataFrame([("d", 1, "Ada wrote; the countess slept", layer)], "doc string, pos int, text string, response string"))
    docs = docs.select("doc", "pos", "text", "entity_layer")
    halves = build.single_pass(docs, aliases=True, split=lambda text: F.split(text, "; "))
    assert [(r.text, r.node_map) for r in halves.sentences.orderBy("sentence_id").collect()] == [("Ada wrote", ["node:d:0"]), ("the countess slept", ["node:d:0"])]
