"""Labels in texts against a plain scanner."""

import random

from pyspark.sql import functions as F

from tessera.operators import matching, resolve
from tessera.plans import retrieval

TEXTS = "text_id int, text string"
LABELS = ["new york", "york", "new york city", "city", "city of new", "hall", "new", "ana", "banana", "st", "new york city hall of"]


def texts_of(n):
    random.seed(n)
    words = ["New", "York", "city", "of", "hall", "banana", "Städte", "x", "of,", "best"]
    return [(k, " ".join(random.choices(words, k=random.randrange(0, 30)))) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "New York City Hall"), (n + 2, "york")]


def scanned(words, labels):
    """From left to right: the longest label at a word, then on behind it."""
    out, at = [], 0
    while at < len(words):
        fits = [x for x in labels if words[at : at + len(x.split())] == x.split()]
        if fits:
            best = max(fits, key=lambda x: len(x.split()))
            out.append((at, len(best.split()), best))
            at += len(best.split())
        else:
            at += 1
    return out


def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower().replace("ä", "a")).split()


def test_longest_labels_as_a_scanner_reads(spark):
    texts = texts_of(300)
    labels = spark.createDataFrame([(x,) for x in [*LABELS, "york", None]], "label string")
    spans = matching.word_spans(spark.createDataFrame(texts, TEXTS).withColumn("start", F.lit(9)), labels)
    got = sorted(tuple(r) for r in matching.longest(spans).where(f"text_id < {300}").collect())
    assert got == sorted((k, *span) for k, text in texts[:300] for span in scanned(plain_words(text), LABELS)) and len(got) > 500


def test_substrings_are_all_found_in_any_number_of_parts(spark):
    texts = texts_of(100)
    labels = [*LABELS, "nan", "a", "ade", ""]
    table = spark.createDataFrame([(x,) for x in labels], "label string")
    want = sorted((k, i, len(x), x) for k, text in texts if text for x in labels if x for i in range(len(text)) if text.lower().replace("ä", "a")[i : i + len(x)] == x)
    for part in (200_000, 4):
        got = matching.substring_spans(spark.createDataFrame(texts, TEXTS), table, part)
        assert sorted(map(tuple, got.collect())) == want
    none = table.limit(0)
    assert matching.substring_spans(spark.createDataFrame(texts, TEXTS), none).collect() == [] and matching.word_spans(spark.createDataFrame(texts, TEXTS), none).collect() == []
    assert matching.longest(matching.word_spans(spark.createDataFrame([], TEXTS), table)).collect() == []


def test_longest_of_substrings(spark):
    spans = matching.substring_spans(spark.createDataFrame([(1, "bananas")], TEXTS), spark.createDataFrame([("ana",), ("nanas",), ("ban",)], "label string"))
    assert sorted(map(tuple, matching.longest(spans).collect())) == [(1, 0, 3, "ban"), (1, 3, 3, "ana")]


def test_links_by_words_by_substrings_and_by_the_longest(spark):
    texts = spark.createDataFrame([(1, "New York City in Newfoundland")], TEXTS)
    labels = spark.createDataFrame([("new", 1), ("new york", 2), ("york", 2), ("found", 3), ("new york city", 4)], "label string, id int")
    links = lambda **how: sorted(map(tuple, resolve.link_labels(texts, labels, **how).collect()))
    assert links() == [(1, 1, 1), (1, 2, 2), (1, 4, 1)]
    assert links(longest=True) == [(1, 4, 1)]
    assert links(within_words=True) == [(1, 1, 2), (1, 2, 2), (1, 3, 1), (1, 4, 1)]


def test_a_long_name_covers_the_names_within_it(spark):
    names = spark.createDataFrame([("a", "New York"), ("b", "York"), ("c", "New York City"), ("d", "City"), ("e", "NEW YORK CITY"), ("f", None)], "node string, name string")
    asked = spark.createDataFrame([(1, "Who lives in New York City?"), (2, "York or New York, city"), (3, None)], "question_id int, question string")
    got = lambda **how: sorted(map(tuple, retrieval.keyword_seeds(asked, names, **how).collect()))
    assert got() == [(1, "c"), (1, "e"), (2, "b"), (2, "c"), (2, "e")]
    assert got(every=True) == [(q, n) for q in (1, 2) for n in "abcde"]
    assert retrieval.keyword_seeds(asked, names.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "new york city hall " * 40_000
    got = matching.longest(matching.word_spans(spark.createDataFrame([(1, text)], TEXTS), spark.createDataFrame([(x,) for x in LABELS], "label string")))
    assert got.groupBy("label").count().orderBy("label").collect() == [("hall", 40_000), ("new york city", 40_000)]


def test_words_of_labels_are_walked_without_a_shuffle(spark):
    texts = [(1, "a b c a b"), (2, "A, b; d"), (3, ""), (4, None), (5, "c"), (6, "b c a")]
    labels = spark.createDataFrame([(x,) for x in ["a b", "a b c", "c", "b", "a  b", "", " a", "c a b", "b c a b x", "b"]], "label string")
    want = {(1, 0, 2, "a b"), (1, 3, 2, "a b"), (1, 0, 3, "a b c"), (1, 2, 1, "c"), (1, 1, 1, "b"), (1, 4, 1, "b"), (1, 2, 3, "c a b"), (2, 0, 2, "a b"), (2, 1, 1, "b"), (5, 0, 1, "c"), (6, 0, 1, "b"), (6, 1, 1, "c")}
    for part in (None, 2):
        spans = matching.word_spans(spark.createDataFrame(texts, TEXTS), labels, part)
        assert sorted(map(tuple, spans.collect())) == sorted(want)
        assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
