"""The pipeline on the smallest tables: every stage's rows against its own input."""

import itertools
import re

import corpus_pipeline
from tessera.llm import jaccard_join, language_id, quality
from tessera.llm.common import table, written

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, FOLDER), "stage")
        if name.startswith("quality"):
            scores = quality.query(spark, FOLDER).where("predicted = 1").select("doc_id")
            assert {r[0] for r in scores.collect()} == {r.doc_id for r in out.collect()}
        elif name.startswith("language"):
            kept = language_id.predicted(docs, language_id.fit(docs)).where(f"lang_pred <> 'und' AND score >= {language_id.FLOOR}")
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out.collect()}
        elif name.startswith("n-gram"):
            assert {r.component_id for r in jaccard_join.join(docs, **jaccard_join.STAGE).collect()} == {r.doc_id for r in out.collect()}
        elif name.startswith("mixing"):
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        if name != names[-1]:
            assert out.columns == docs.columns
        docs = out


def brute_kept(texts, width, numerator, denominator):
    """Least ids of the groups of texts whose shingle sets are near, by comparing every pair."""
    cut = [re.findall(r"[^\x20\x09-\x0D]+", x.lower()) for x in texts]
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in cut]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return set(root)


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    # Pairs of 100 words of which none to four are replaced: two are near by five words and 0.8 alone.
    texts = []
    for n in range(5):
        base = [f"w{n}x{k}" for k in range(100)]
        texts += [" ".join(base), " ".join("new" if k in range(15, 15 + 20 * n, 20) else w for k, w in enumerate(base))]
    docs = spark.createDataFrame([(k, x, "en", "a", len(x)) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_kept(texts, 5, 80, 100)
    assert want != brute_kept(texts, 4, 85, 100)
    assert {r.doc_id for r in jaccard_join.stage(spark, docs, FOLDER).collect()} == want
