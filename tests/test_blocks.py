"""Text scores by blocks of documents: the same for equal texts however rows are dealt, and the same rankings as whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, fusion

LETTERS = "abcdefghijklmnop"


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(LETTERS, weights=range(16, 0, -1), k=rng.randint(0, 30))) for _ in range(150)] + [None, "zz", ""]
    docs = spark.createDataFrame([(f"d{n:03}", x) for n, x in enumerate(texts + texts[:60])], "doc string, text string")
    asked = spark.createDataFrame([(n, " ".join(rng.choices(LETTERS, k=12))) for n in range(7)] + [(7, "nothing here"), (8, None)], "question_id int, text string")
    return docs, asked, bm25.build(docs)


def by_hand(index, asked):
    """Parts in order of their words, each from left to right as the SQL has it."""
    idf = {r.term: r.idf for r in index.idf.collect()}
    avgdl = index.stats.first().avgdl
    out = {}
    for d, words in index.tokens.collect():
        for q, text in asked.collect():
            have = sorted({w for w in (text or "").split()} & set(words or []))
            for w in have:
                tf = words.count(w)
                part = text.split().count(w) * idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avgdl))
                out[q, d] = out.get((q, d), 0.0) + part
    return out


@pytest.mark.parametrize("questions", [0, 1000])
def test_scores_are_added_in_order_of_words(spark, made, monkeypatch, questions):
    docs, asked, index = made
    monkeypatch.setattr(bm25, "QUESTIONS", questions)
    found = {(r.question_id, r.doc): r.score for r in bm25.scores(index, asked).collect()}
    assert found == by_hand(index, asked)
    again = bm25.scores(bm25.build(docs.repartition(7)), asked)
    assert {(r.question_id, r.doc): r.score for r in again.collect()} == found
    twins = {t: {q: found.get((q, d)) for q in range(9)} for d, t in docs.collect()}
    assert all(twins[t][q] == found.get((q, d)) for d, t in docs.collect() for q in range(9))


@pytest.mark.parametrize("size,counted", [(1_000_000, 1000), (40, 0)])
def test_rankings_by_blocks(spark, made, monkeypatch, size, counted):
    docs, asked, index = made
    monkeypatch.setattr(bm25, "PAIRS", size)
    monkeypatch.setattr(bm25, "WANTED", counted)
    blocks = bm25.Blocks.of(index, asked)
    whole = {(r.question_id, r.doc): r.rnk for r in blocks.whole().collect()}
    plain = bm25.full_ranking(bm25._joined_scores(index, asked, "question_id", "text", 1.5, 0.75), asked, docs)
    assert whole == {(r.question_id, r.doc): r.rnk for r in plain.collect()} and len(whole) == 9 * docs.count()
    assert {(r.question_id, r.item): r.rnk for r in blocks.top(17).collect()} == {k: v for k, v in whole.items() if v <= 17}
    wanted = [k for n, k in enumerate(whole) if n % 5 == 0]
    rows = spark.createDataFrame(wanted + wanted[:3], "question_id int, item string")
    assert {(r.question_id, r.item): r.rnk for r in blocks.ranks(rows).collect()} == {k: whole[k] for k in wanted}
    few = fusion.rrf_top([blocks.ranking()], 9)
    assert {(r.question_id, r.item) for r in few.collect()} == {k for k, v in whole.items() if v <= 9}


def test_columns_beside_the_tokens(spark, made):
    docs, asked, _ = made
    index = bm25.build(docs.withColumn("size", F.length("text")), keep=("size",))
    rows = bm25.Blocks.of(index, asked).every(index.tokens)
    assert {(r.doc, r.size) for r in rows.collect()} == {(d, None if t is None else len(t)) for d, t in docs.collect()}
    assert bm25.Blocks.of(index, asked.limit(0)).every().count() == 0
