"""Okapi BM25 as tables: postings, statistics, scores, rankings.

Scores do not depend on how rows are dealt: few questions are scored by blocks of documents, a score's parts added in order of their words; the mean of idf is a sum of decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.stages import written
from .fusion import Ranking, first_rows, in_order, places


#: Distinct query terms that are broadcast.
FEW = 500_000
#: Questions that are scored by blocks of documents; pairs of both in a block; rows that a task gives away at a time; wanted ranks that are counted within blocks.
QUESTIONS, PAIRS, GIVEN, WANTED = 1000, 1_000_000, 200_000, 50_000


@dataclass(frozen=True)
class Index:
    """tokens (doc, tokens), idf (term, df, idf), stats (one row: n, avgdl)."""

    tokens: DataFrame
    idf: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, doc, tf) of all terms."""
        return self.tokens.select("doc", F.explode("tokens").alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))


def tokenised(docs: DataFrame, doc: str = "doc", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), tokens(text).alias("tokens"), *keep)


def build(docs: DataFrame, doc: str = "doc", text: str = "text", epsilon: float = 0.25, keep: tuple[str, ...] = ()) -> Index:
    """docs (doc, text). A term in more than half of the documents gets epsilon times the mean idf of all terms.

    Documents count once for each distinct term, within their row, so that the exchange holds the vocabulary and not the postings. Columns in `keep` stay beside the tokens.
    """
    rows = written(tokenised(docs, doc, text, keep), "bm25-tokens")  # texts are cut once, for statistics, vocabulary and hits
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    raw = rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = written(raw, "bm25-vocabulary").withColumn("_k", F.lit(0))
    # One row of statistics meets the terms; the join on a constant is a broadcast of that row.
    stats_row = F.broadcast(stats.withColumn("_k", F.lit(0)))
    value = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # Decimals add to the same mean in any order; terms of the same df are added as one.
    sizes = raw.groupBy("df", "_k").agg(F.count(F.lit(1)).alias("m")).join(stats_row, "_k")
    mean = F.sum((F.col("m") * value).cast("decimal(38,18)")).cast("double") / F.sum("m")
    floor = sizes.agg((mean * epsilon).alias("floor"), F.lit(0).alias("_k"))
    idf = raw.join(stats_row, "_k").withColumn("raw", value).join(F.broadcast(floor), "_k").select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return Index(rows, idf, stats)


def scores(index: Index, questions: DataFrame, question: str = "question_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """question_id, doc, score of documents that share a token; a repeated query token counts again.

    Up to QUESTIONS questions (counted) are scored by blocks. Of more, terms that no question has leave before they are shuffled. Hits are dealt by document once: counts of terms and
    sums of scores need no other exchange, as long as the questions' terms, which are counted, can be broadcast.
    """
    blocks = Blocks.of(index, questions, question, text, k1, b)
    return _joined_scores(index, questions, question, text, k1, b) if blocks is None else blocks.scores()


def _asked(index: Index, questions: DataFrame, question: str, text: str) -> DataFrame:
    """(question_id, term, times, idf) of the questions' words that documents have."""
    asked = questions.select(F.col(question).alias("question_id"), F.explode(tokens(text)).alias("term"))
    asked = asked.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return written(asked.join(index.idf, "term").select("question_id", "term", "times", "idf"), "bm25-asked")


def _joined_scores(index: Index, questions: DataFrame, question: str, text: str, k1: float, b: float) -> DataFrame:
    asked = _asked(index, questions, question, text)
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= FEW else terms
    hits = index.tokens.select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
    hits = hits.repartition("doc").groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))
    hits = hits.join(F.broadcast(asked) if asked.count() <= FEW else asked, "term").join(F.broadcast(index.stats.withColumn("_k", F.lit(0))), F.lit(0) == F.col("_k"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # Parts are added in order of their words: equal texts have equal scores.
    parts = F.array_sort(F.collect_list(F.struct("term", part.alias("part"))))
    return hits.groupBy("question_id", "doc").agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))


def rounded(x: np.ndarray) -> np.ndarray:
    """To nine digits, halves away from zero, without a negative zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e9 + 0.5) / 1e9 + 0.0


class Blocks:
    """Few questions against all documents: a task scores blocks of the documents that it reads, and only what is asked for leaves it. Nothing is shuffled."""

    def __init__(self, index: Index, asked: DataFrame, ids: list, k1: float, b: float):
        import pyarrow as pa

        self.tokens, self.spark, self.kind = index.tokens, index.tokens.sparkSession, asked.schema["question_id"].dataType.simpleString()
        table = asked.select("question_id", "term", (F.col("times") * F.col("idf")).alias("weight")).orderBy("term", "question_id").toArrow().combine_chunks()
        ids = pa.array(ids, table.schema.field("question_id").type)
        terms = table.column("term").combine_chunks() if table.num_rows else pa.array([], pa.string())
        listed = terms.unique()
        codes = np.array(terms.to_pylist(), dtype=object)
        first = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1 if len(codes) else [], len(codes)).astype(int)
        place = {q: n for n, q in enumerate(ids.to_pylist())}
        question = np.array([place[q] for q in table.column("question_id").to_pylist()], dtype=int)
        self.ids = ids
        self.sent = self.spark.sparkContext.broadcast((ids, listed, np.append(0, first) if len(codes) else np.zeros(1, int), question, table.column("weight").to_numpy(), index.stats.first()["avgdl"] or 1.0, k1, b))

    @classmethod
    def of(cls, index: Index, questions: DataFrame, question: str = "question_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> Blocks | None:
        """None of more than QUESTIONS questions or FEW of their words, which are counted."""
        distinct = questions.select(F.col(question).alias("_q")).where("_q IS NOT NULL").distinct()
        if distinct.count() > QUESTIONS:
            return None
        asked = _asked(index, questions.where(F.col(question).isNotNull()), question, text)
        return None if asked.count() > FEW else cls(index, asked, sorted(r[0] for r in distinct.collect()), k1, b)

    def _run(self, rows: DataFrame, names: list[str], give, schema: str) -> DataFrame:
        """give(ids, blocks) over each task's blocks of rows (names, tokens): (a batch of the columns in names, scores, shared), matrices of documents by questions."""
        import pyarrow.compute as pc

        sent = self.sent

        def blocks(batches) -> Iterator:
            ids, terms, first, question, weight, avgdl, k1, b = sent.value
            size, width = max(1, PAIRS // max(1, len(ids))), len(terms)
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    block = batch.slice(at, size)
                    n, listed = block.num_rows, block.column("tokens")
                    length = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    code = pc.fill_null(pc.index_in(listed.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(n), length)
                    key, tf = np.unique(code[code >= 0].astype(np.int64) * n + row[code >= 0], return_counts=True)
                    term, row = np.divmod(key, n)
                    under = tf + k1 * (1 - b + b * length[row] / avgdl)
                    score, shared = np.zeros((n, len(ids))), np.zeros((n, len(ids)), bool)
                    ends = np.searchsorted(term, np.arange(width + 1))
                    for t in np.unique(term):
                        of, at_rows = slice(ends[t], ends[t + 1]), row[ends[t] : ends[t + 1]]
                        asking = slice(first[t], first[t + 1])
                        cell = np.ix_(at_rows, question[asking])
                        score[cell] += weight[asking][None, :] * tf[of, None] * (k1 + 1) / under[of, None]
                        shared[cell] = True
                    yield block.select(names), score, shared

        def run(batches):
            yield from give(sent.value[0], blocks(batches))

        return rows.select(*names, "tokens").mapInArrow(run, schema)

    def _schema(self, rows: DataFrame, names: list[str]) -> str:
        return ", ".join([f"question_id {self.kind}", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names], "score double"])

    def _rows(self, rows: DataFrame, every: bool) -> DataFrame:
        import pyarrow as pa

        names = [c for c in rows.columns if c != "tokens"]

        def give(ids, blocks):
            for held, score, shared in blocks:
                step = max(1, GIVEN // max(1, held.num_rows))
                for k in range(0, len(ids), step):
                    part = score[:, k : k + step].T
                    asked, row = np.nonzero(np.ones(part.shape, bool) if every else shared[:, k : k + step].T)
                    columns = [held.column(c).take(pa.array(row)) for c in names]
                    yield pa.record_batch([ids.take(pa.array(asked + k)), *columns, pa.array(rounded(part[asked, row]) if every else part[asked, row])], ["question_id", *names, "score"])

        return self._run(rows, names, give, self._schema(rows, names))

    def scores(self) -> DataFrame:
        """question_id, doc, score of documents that share a token."""
        return self._rows(self.tokens.select("doc", "tokens"), False)

    def every(self, rows: DataFrame | None = None) -> DataFrame:
        """question_id, doc, score (nine digits) of all documents, 0 where nothing is shared; rows (doc, tokens) may be some of the index's, with more columns, which are kept."""
        return self._rows(self.tokens.select("doc", "tokens") if rows is None else rows, True)

    def whole(self) -> DataFrame:
        """The full ranking: every document's rnk for every question, by falling score, ties by document."""
        order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc")
        return self.every().withColumn("rnk", F.row_number().over(order))

    def top(self, k: int) -> DataFrame:
        """The first k rows of the full ranking: question_id, item, score, rnk. A task gives away k a question."""
        import pyarrow as pa

        def give(ids, blocks):
            kept, kind = None, None
            bound = np.full(len(ids), np.inf)  # of each question the k-th value so far
            for held, score, _ in blocks:
                doc, kind = held.column("doc").to_numpy(zero_copy_only=False), held.schema.field("doc").type
                value = -rounded(score.T) + 0.0
                limit = np.fmin(bound, np.partition(value, k - 1, axis=1)[:, k - 1]) if len(doc) > k else bound
                asked, row = np.nonzero(value <= limit[:, None])
                more = (asked, value[asked, row], doc[row])
                kept = first_rows(k, *(more if kept is None else [np.concatenate(x) for x in zip(kept, more)]))
                last = np.flatnonzero(np.append(kept[0][1:] != kept[0][:-1], True)) if len(kept[0]) else np.zeros(0, int)
                full = last[np.bincount(kept[0], minlength=len(ids))[kept[0][last]] == k]
                bound[kept[0][full]] = kept[1][full]
            if kept is not None:
                yield pa.record_batch([ids.take(pa.array(kept[0])), pa.array(kept[2], kind), pa.array(-kept[1] + 0.0)], ["question_id", "doc", "score"])

        found = self._run(self.tokens, ["doc"], give, self._schema(self.tokens, ["doc"]))
        order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc")
        return found.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k).withColumnRenamed("doc", "item")

    def ranks(self, wanted: DataFrame) -> DataFrame:
        """Ranks of wanted (question_id, item) in the full ranking: question_id, item, rnk. Up to WANTED are counted where documents are scored."""
        wanted = written(wanted.select("question_id", F.col("item").alias("doc")).distinct(), "bm25-wanted")
        some = self.tokens.select("doc", "tokens").join(wanted.select("doc").distinct(), "doc", "left_semi")
        rows = written(self.every(some).join(wanted, ["question_id", "doc"], "left_semi"), "bm25-wanted")
        key = F.struct((-F.col("score") + 0.0).alias("s"), F.col("doc").alias("d")).alias("key")
        if rows.count() > WANTED:
            told = rows.select("question_id", key)
            return places(self.every().select("question_id", key), told).select("question_id", F.col("key.d").alias("item"), (F.col("before") + 1).alias("rnk"))
        import pyarrow as pa

        table = rows.select("question_id", "doc", "score").toArrow().combine_chunks()
        place = {q: n for n, q in enumerate(self.ids.to_pylist())}
        listed: dict[int, list] = {}
        for n, q in enumerate(table.column("question_id").to_pylist()):
            listed.setdefault(place[q], []).append(n)
        sent = self.spark.sparkContext.broadcast((table.column("doc").to_numpy(), table.column("score").to_numpy(), listed))

        def give(ids, blocks):
            docs, values, listed = sent.value
            before = np.zeros(len(docs), np.int64)
            for held, score, _ in blocks:
                doc = held.column("doc").to_numpy(zero_copy_only=False)
                for q, every in listed.items():
                    value = rounded(score[:, q])
                    for n in every:
                        before[n] += np.count_nonzero(value > values[n])
                        tied = np.flatnonzero(value == values[n])
                        if len(tied):
                            before[n] += np.count_nonzero(doc[tied] < docs[n])
            yield pa.record_batch([pa.array(np.arange(len(docs))), pa.array(before)], ["_w", "_n"])

        counted = self._run(self.tokens, ["doc"], give, "_w bigint, _n bigint").groupBy("_w").agg(F.sum("_n").alias("_n"))
        out = self.spark.createDataFrame(table.select(["question_id", "doc"]).append_column("_w", pa.array(np.arange(table.num_rows)))).join(counted, "_w")
        return out.select("question_id", F.col("doc").alias("item"), (F.col("_n") + 1).alias("rnk"))

    def ranking(self) -> Ranking:
        return Ranking(self.top, self.ranks)


def topk(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents a question; ties go to the lesser document. Spark cuts ranks before the exchange."""
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "doc")
    return scored.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def full_ranking(scored: DataFrame, questions: DataFrame, docs: DataFrame, question: str = "question_id", doc: str = "doc") -> DataFrame:
    """Every document's rank for every (of few) questions, those without a score last with score 0."""
    every = docs.select(F.col(doc).alias("doc"))
    asked = questions.select(F.col(question).alias("question_id"))
    listed = asked.agg(F.collect_set("question_id").alias("_q"), F.lit(0).alias("_k"))
    pairs = every.withColumn("_k", F.lit(0)).join(F.broadcast(listed), "_k").select("doc", F.explode("_q").alias("question_id"))
    out = pairs.join(scored, ["question_id", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "doc")
    return out.withColumn("rnk", F.row_number().over(order))


def ranking(scored: DataFrame, questions: DataFrame, docs: DataFrame, question: str = "question_id", doc: str = "doc") -> Ranking:
    """The full ranking of all documents for each question, without the product of both.

    Documents that share no word with a question score 0 and stand in order of their ids between those above and below 0. Their ranks are arithmetic: of a document's
    number among all, those before it that have a score are taken off, and those ranked above it are added. Scored documents are counted, not sorted.
    """
    scored = written(scored.select("question_id", "doc", F.round("score", 9).alias("score")), "bm25-scores")
    asked, ids = questions.select(F.col(question).alias("question_id")).distinct(), docs.select(F.col(doc).alias("doc")).distinct()
    counts = scored.groupBy("question_id").agg(F.count_if(F.col("score") > 0).alias("above"), F.count_if(F.col("score") < 0).alias("below"), F.count(F.lit(1)).alias("all"))
    counts = asked.join(counts, "question_id", "left").select("question_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("above", "below", "all")])
    counts = written(counts, "bm25-counts")  # one row a question

    def top(k: int) -> DataFrame:
        best = topk(scored, k)
        short = counts.where(F.col("above") < k)
        most = short.agg(F.max("all")).first()[0]
        if most is not None:
            # Of the first k + most documents by id, at least k (or all) have no score for the question.
            first = ids.orderBy("doc").limit(k + most).withColumn("_k", F.lit(0))
            fill = short.select("question_id", F.lit(0).alias("_k")).join(first, "_k").drop("_k").join(scored, ["question_id", "doc"], "left_anti")
            best = topk(best.drop("rnk").unionByName(fill.withColumn("score", F.lit(0.0))), k)
        return best.withColumnRenamed("doc", "item")

    #: Documents with a score are placed among such by score, those without among all others by id.
    by_score = F.struct(F.lit(0).alias("k"), (-F.col("score")).alias("s"), F.col("doc").alias("d"))
    by_id = F.struct(F.lit(1).alias("k"), F.lit(0.0).alias("s"), F.col("doc").alias("d"))

    def ranks(wanted: DataFrame) -> DataFrame:
        rows = wanted.withColumnRenamed("item", "doc").join(scored, ["question_id", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        rows = written(rows.withColumn("key", F.when(F.col("score") == 0, by_id).otherwise(by_score)), "bm25-wanted")
        told = scored.where("score <> 0").select("question_id", F.explode(F.array(by_score, by_id)).alias("key"))
        out = rows.join(places(told, rows.select("question_id", "key")), ["question_id", "key"]).join(counts, "question_id")
        # Before a key by id lie all keys by score, and the scored documents of lesser id.
        nonzero = F.col("above") + F.col("below")
        number = in_order(ids, ["doc"])
        zero = out.where("score = 0").join(number, "doc").select("question_id", "doc", (F.col("above") + F.col("number") - (F.col("before") - nonzero)).alias("rnk"))
        unscored = F.lit(ids.count()) - nonzero
        other = out.where("score <> 0").select("question_id", "doc", (F.col("before") + 1 + F.when(F.col("score") < 0, unscored).otherwise(0)).alias("rnk"))
        return zero.unionByName(other).withColumnRenamed("doc", "item")

    return Ranking(top, ranks)
