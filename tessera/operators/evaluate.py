"""Answer quality: normalised tokens, F1, exact and containment match, aggregate metrics."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import col
from ..functions.text import normal_answer


def answer_tokens(text) -> Column:
    return F.filter(F.split(normal_answer(text), " "), lambda w: w != "")


def token_f1(prediction, truth) -> Column:
    """F1 of two answers' token multisets; 0 if they share none. Row-local: both answers' tokens are sorted together and folded once."""
    a, b = answer_tokens(prediction), answer_tokens(truth)
    tagged = F.array_sort(F.concat(F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(0).alias("t"))), F.transform(b, lambda w: F.struct(w.alias("w"), F.lit(1).alias("t")))))

    def step(acc, x):
        again = acc["w"] == x["w"]
        mine = lambda name, t: F.when(again, acc[name]).otherwise(0) + F.when(x["t"] == t, 1).otherwise(0)
        return F.struct(x["w"].alias("w"), mine("a", 0).alias("a"), mine("b", 1).alias("b"), (acc["same"] + F.when(again, 0).otherwise(F.least(acc["a"], acc["b"]))).alias("same"))

    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("same"))
    facts = F.aggregate(tagged, start, step, lambda acc: acc["same"] + F.least(acc["a"], acc["b"]))
    # p and r are same / sizes: the harmonic mean is 2 same / (both sizes).
    size = (F.size(a) + F.size(b)).cast("double")
    return F.coalesce(F.try_divide(2.0 * facts, size), F.lit(0.0))


def exact_match(prediction, truth) -> Column:
    return normal_answer(prediction) == normal_answer(truth)


def contains_match(prediction, truths) -> Column:
    """Does any truth contain the prediction, or the other way round (lower-cased)? An empty prediction matches everything."""
    p = F.lower(col(prediction))
    return F.exists(truths, lambda t: p.contains(F.lower(t)) | F.lower(t).contains(p))


def metrics(rows: DataFrame) -> DataFrame:
    """rows (predict, f1, em, error): counts and means over rows without an error, as percentages."""
    good = rows.where(F.col("error").isNull())
    percent = lambda c: F.round(100 * F.avg(F.col(c).cast("double")), 4)
    return good.agg(F.count(F.lit(1)).alias("rows"), percent("predict").alias("accuracy"), percent("f1").alias("f1"), percent("em").alias("em"))


def judged(rows: DataFrame) -> DataFrame:
    """The judge's verdict, true wherever containment holds."""
    return rows.withColumn("predict", F.coalesce("predict", F.lit(False)) | F.coalesce("has_answer_match", F.lit(False)))


class Timer:
    """Seconds that a named block takes, kept by name."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start


def distinct_answers(rows: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """Distinct answers of each key, without regard to case and outer spaces."""
    return rows.groupBy(key).agg(F.count_distinct(F.lower(F.trim(answer))).alias("n"))
