"""Operator 2, quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Each text becomes 18 statistics (lengths, shares of character classes, repetition of words, word
runs and lines, byte entropy), by numpy over Arrow bytes. Random Fourier features of the
standardised statistics approximate a Gaussian kernel. Each partition of the labelled rows sums its
own normal equations (a matrix of fixed size); the sums of TRAIN_PARTS partitions meet on the driver.
Raw scores of other labelled rows, counted in BINS bins, are made probabilities by pooling adjacent violators.

Labels come from rows whose crc32 of the id modulo 4 is not 2: 0 and 1 teach the ridge, 3 the
calibration. At most about TRAIN_ROWS labelled rows are used, a sample by hash of the id; all rows
are scored. Neither id, language, source nor labels are inputs of a score.

Null and empty texts have statistics 0 and a score like any other. A document with several labels
counts its least. Without any labelled row every score is 0.5. Repeated rows get equal scores; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, table, trimmed, written
from .shingles import SEGMENT, shingle_hashes, slices, text_bytes, word_hashes

#: Random features, kernel width (in standard deviations), ridge, labelled rows used, partitions of them, score bins.
FEATURES, WIDTH, RIDGE, TRAIN_ROWS, TRAIN_PARTS, BINS, SEED, CUT = 384, 3.0, 1e-3, 200_000, 16, 4096, 17, 0.7
STATS = 18

_byte = np.arange(256)
_classes = {
    "upper": (_byte >= 65) & (_byte <= 90),
    "lower": (_byte >= 97) & (_byte <= 122),
    "digit": (_byte >= 48) & (_byte <= 57),
    "space": np.isin(_byte, [9, 10, 11, 12, 13, 32]),
    "stop": np.isin(_byte, [33, 44, 46, 58, 59, 63]),
    "loud": _byte == 33,
    "symbol": np.isin(_byte, [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]),
    "high": _byte >= 128,
    "line": _byte == 10,
    "period": _byte == 46,
}
CLASSES = np.stack([*_classes.values()], 1).astype(np.float64)


def repeats(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct hashes, and the count of the most frequent one."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))) if len(r) else np.zeros(0, int)
    runs = np.diff(np.append(first, len(r)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[first], runs)
    return np.bincount(r[first], minlength=n), most


def statistics(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The statistics of every row of texts given as bytes and offsets."""
    n = len(ends) - 1
    table = np.zeros((n, 256))
    for a in range(0, len(raw), SEGMENT):  # of a long text a segment at a time; its rows alone
        b = min(a + SEGMENT, len(raw))
        low, high = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b - 1, "right")
        rows = np.repeat(np.arange(high - low), np.diff(np.clip(ends[low : high + 1], a, b)))
        table[low:high] += np.bincount(rows * 256 + raw[a:b], minlength=(high - low) * 256).reshape(-1, 256)
    size = table.sum(1)
    part = table / np.maximum(size, 1)[:, None]
    upper, lower, digit, space, stop, loud, symbol, high, line, period = (part @ CLASSES).T
    entropy = -(part * np.log2(np.where(part > 0, part, 1))).sum(1)
    words, of = word_hashes(raw, ends)
    count = np.bincount(of, minlength=n)
    some = np.maximum(count, 1)
    distinct, most = repeats(of, words, n)
    same = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(of) else np.zeros(n)
    grams, owner = shingle_hashes(raw, ends)
    whole = np.maximum(np.bincount(owner, minlength=n), 1)
    fresh, _ = repeats(owner, grams, n)
    fresh = np.where(count > 0, fresh, 1)
    cols = [
        np.log1p(size), np.log1p(count), np.where(count > 0, (size - space * size) / some, 0), upper / np.maximum(upper + lower + high, 1e-9), upper, digit,
        space, stop, loud, symbol, high, np.log1p(line * size), period * size / some, entropy,
        np.where(count > 0, distinct / some**0.8, 0), most / some, same / some, np.where(count > 0, 1 - fresh / whole, 0),
    ]
    return np.stack(cols, 1)


def batch_statistics(column) -> np.ndarray:
    raw, ends = text_bytes(column)
    parts = [statistics(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in slices(ends)]
    return np.concatenate(parts) if parts else np.zeros((0, STATS))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its text's statistics as packed doubles, for every row of docs."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([x.tobytes() for x in batch_statistics(b.column(1))], pa.binary())], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, stats binary")


def unstats(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, STATS)


@dataclass
class Model:
    """All that scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    spread: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w, b = rng.normal(0, 1 / WIDTH, (STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.cos(np.clip((x - self.mean) / self.spread, -8, 8) @ w + b) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values) if len(self.knots) else np.full(len(x), 0.5)


def pooled(at: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: centres of the pools, ascending, and their means."""
    pools: list[list[float]] = []
    for x, g, c in zip(at, good, count):
        pools.append([x * c, float(g), float(c)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    # A pool of few rows is not certain: half a row of each kind is added.
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate(np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools]))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats (doc_id, stats) of at least the labelled documents; labels (doc_id, quality)."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    told = told.where(~held_out())
    rows = told.count()
    if rows > TRAIN_ROWS:
        told = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(TRAIN_ROWS / rows * (1 << 20)))
    known = stats.join(told, "doc_id").withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 4)
    known = written(known.repartition(TRAIN_PARTS, "doc_id"), "quality-train")

    def moments(batches):
        total = np.zeros((3, STATS))
        for b in batches:
            x = unstats(b.column(0))
            total += [np.full(STATS, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], ["part", "sums"])

    gathered = lambda df: [r[1] for r in sorted(df.collect())]  # noqa: E731  at most some partitions of fixed-size sums
    sums = sum((np.frombuffer(x).reshape(3, STATS) for x in gathered(known.select("stats").mapInArrow(moments, "part bigint, sums binary"))), np.zeros((3, STATS)))
    empty = np.zeros(0)
    if not sums[0, 0]:
        return Model(np.zeros(STATS), np.ones(STATS), np.zeros(FEATURES + 1), empty, empty)
    mean = sums[1] / sums[0]
    spread = np.sqrt(np.maximum(sums[2] / sums[0] - mean**2, 0)) + 1e-6
    model = Model(mean, spread, np.zeros(FEATURES + 1), empty, empty)
    size = FEATURES + 1

    def normal(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            z = model.lift(unstats(b.column(0)))
            total += z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], ["part", "sums"])

    taught = known.where("fold <> 3").select("stats", "y")
    both = sum((np.frombuffer(x).reshape(size, size + 1) for x in gathered(taught.mapInArrow(normal, "part bigint, sums binary"))), np.zeros((size, size + 1)))
    ridge = np.eye(size) * RIDGE * max(1.0, both[-1, -2])
    ridge[-1, -1] = 1e-9
    model.beta = np.linalg.solve(both[:, :-1] + ridge, both[:, -1])

    def binned(batches):
        for b in batches:
            at = np.clip(((model.raw(unstats(b.column(0))) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.record_batch([pa.array(at), b.column(1)], ["at", "y"])

    held = known.where("fold = 3").select("stats", "y").mapInArrow(binned, "at bigint, y double")
    counts = held.groupBy("at").agg(F.sum("y"), F.count("y")).orderBy("at").collect()  # at most BINS rows
    if counts:
        at, good, count = (np.array(x, np.float64) for x in zip(*counts))
        model.knots, model.values = pooled((at + 0.5) / BINS * 2 - 0.5, good, count)
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of rows with packed statistics."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model.score(unstats(b.column(1))), pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "stats").mapInArrow(run, "doc_id bigint, score double")


def kept(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, whose text scores `cut` or more; no shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(batch_statistics(b.column(at))) >= cut, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(features(table(spark, sf_dir, "documents")), "quality-stats")
    model = fit(stats, table(spark, sf_dir, "labels"))
    out = scored(stats, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier predicts to be of quality stay."""
    labels = table(spark, sf_dir, "labels")
    stats = written(features(docs), "quality-stats")
    return kept(docs, fit(stats, labels))
