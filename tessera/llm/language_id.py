"""Operator 7, language identification by prediction by partial matching.

For each language a tree of byte contexts of zero to ORDER bytes is counted on a bounded sample of texts (those of the
least hashes of ids, about DOCS_A_LANGUAGE of each language). Frozen, it gives every byte an exact code length: the longest context of
the byte that is in the tree predicts it, or escapes to the next shorter one with probability distinct / (total + distinct)
(method C); bytes that the longer context knows are excluded from the shorter one, and bytes that no context knows are equally likely.
All 256 bytes are told apart, A-Z being lower-cased. A whole text's language is the one whose tree codes it in the fewest bits.

The trees are sparse: sorted arrays of the contexts and of the bytes seen in them. Scoring goes through texts a window of
WINDOW bytes at a time, whatever their lengths; code lengths (in 1 / SCALE bits, so that sums are exact) of the contexts that
texts use again and again are kept in a table of fixed size, and only others are looked up in the trees. No shuffle.

Only rows whose crc32 of the id modulo 4 is not 2 teach. Null texts and texts without a letter are `und` with score 0. The score is
the posterior share of the best language, with the evidence of texts over EVIDENCE bytes scaled to that length. Ties go to
the first language by name. Without any taught language all are `und`. Repeated rows get equal results; an empty
table gives an empty result; of other columns none is read. What the driver and each worker hold are the sample's distinct
contexts: they grow with the number of languages, not with the table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, table, trimmed, written
from .shingles import text_bytes

ORDER, DOCS_A_LANGUAGE, EVIDENCE, SCALE, FLOOR, WINDOW = 4, 400, 200, 4096, 0.5, 1 << 18
#: Languages that are broadcast with their counts; entries of a worker's table of code lengths, over all languages.
FEW, KEPT = 20_000, 1 << 21
PAD = 32

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def windows(raw: np.ndarray, ends: np.ndarray, size: int = WINDOW):
    """(codes, rows) of the bytes of texts, a window at a time: a code holds a byte and, above it, the ORDER bytes before it in its text, or pads."""
    for a in range(0, len(raw), size):
        halo = min(a, ORDER)
        part = LOWERED[raw[a - halo : a + size]].astype(np.int64)
        low, high = np.searchsorted(ends[:-1], [a - halo, a - halo + len(part)])
        starts = ends[low:high] - (a - halo)
        code = part.copy()
        for k in range(1, ORDER + 1):
            before = np.full(len(part), PAD, np.int64)
            before[k:] = part[:-k]
            for j in range(k):
                at = starts + j
                before[at[at < len(part)]] = PAD
            code += before << 8 * k
        rows = np.searchsorted(ends, np.arange(a, min(a + size, len(raw))), "right") - 1
        yield code[halo:], rows


class Tree:
    """One language's frozen contexts, from counts of codes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels = []  # by order: contexts, distinct bytes, log2 of total and of escape (own, and after an escape from it to the shorter one), grams, log2 of counts
        shorter = None
        for order in range(ORDER + 1):
            grams, of = np.unique(codes & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            n = np.bincount(of, counts).astype(np.int64)
            contexts, owner = np.unique(grams >> 8, return_inverse=True)
            total, distinct = np.bincount(owner, n).astype(np.int64), np.bincount(owner)
            own = self._logs(total, distinct, 256)
            after = None
            if shorter is not None:
                grams0, n0, contexts0, total0, distinct0 = shorter
                known = np.bincount(owner, n0[np.searchsorted(grams0, grams & (1 << 8 * order) - 1)]).astype(np.int64)
                at = np.searchsorted(contexts0, contexts & (1 << 8 * (order - 1)) - 1 if order > 1 else np.zeros(len(contexts), np.int64))
                after = self._logs(total0[at] - known, distinct0[at] - distinct, 256 - distinct)
            self.levels.append((contexts, distinct, own, after, grams, np.log2(n)))
            shorter = grams, n, contexts, total, distinct

    @staticmethod
    def _logs(total: np.ndarray, distinct: np.ndarray, possible) -> tuple[np.ndarray, np.ndarray]:
        """log2 of what counts are divided by, and the code length of an escape (0 where there is nothing to escape from)."""
        whole = total + np.where(distinct == possible, 0, distinct)
        base = np.log2(np.maximum(whole, 1))
        return base, np.where(distinct > 0, base - np.log2(np.maximum(distinct, 1)), 0.0)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the byte of each code after its context."""
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        came = np.full(len(codes), -1)  # the longer context that was escaped from
        for order in range(ORDER, -1, -1):
            contexts, _, own, _, grams, logs = self.levels[order]
            context, gram = codes >> 8 & (1 << 8 * order) - 1, codes & (1 << 8 * (order + 1)) - 1
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            here = open_ & (contexts[at] == context)
            base, escape = own[0][at], own[1][at]
            if order < ORDER:
                after, fell = self.levels[order + 1][3], came >= 0
                base = np.where(fell, after[0][came], base)
                escape = np.where(fell, after[1][came], escape)
            k = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            seen = here & (grams[k] == gram)
            out += np.where(seen, base - logs[k], np.where(here, escape, 0.0))
            open_ &= ~seen
            came = np.where(here, at, came if order == ORDER else -1)
        return out + np.where(open_, np.log2(np.maximum(256 - self.levels[0][1][0], 1)), 0.0)


_kept: list[Trees] = []


class Trees:
    """The languages' counted codes; trees and the table of code lengths are made once a worker."""

    def __init__(self, languages: list[str], codes: list[np.ndarray], counts: list[np.ndarray]):
        self.languages, self.codes, self.counts, self.name = languages, codes, counts, uuid.uuid4().hex

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("languages", "codes", "counts", "name")}

    def here(self) -> Trees:
        """This model, or its equal that an earlier task has left in this worker with its trees made; a worker keeps one model."""
        if not _kept or _kept[0].name != self.name:
            _kept[:] = [self]
        return _kept[0]

    def trees(self) -> list[Tree]:
        if "_trees" not in self.__dict__:
            self._trees = [Tree(c, n) for c, n in zip(self.codes, self.counts)]
            bits = max(8, int(np.log2(KEPT / len(self.languages))))
            self._shift = np.uint64(64 - bits)
            self._keys = np.full(1 << bits, -1, np.int64)
            self._lengths = np.zeros((1 << bits, len(self.languages)), np.int32)
        return self._trees

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths, in 1 / SCALE bits, of codes in every language."""
        return np.stack([np.round(t.bits(codes) * SCALE).astype(np.int32) for t in self.trees()], 1)

    def sums(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        out = np.zeros((len(ends) - 1, len(self.languages)), np.int64)
        if not len(self.languages):
            return out.astype(np.float64)
        self.trees()
        for codes, rows in windows(raw, ends):
            slot = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift
            lengths = self._lengths[slot]
            lost = np.flatnonzero(self._keys[slot] != codes)
            if len(lost):
                fresh, where = np.unique(codes[lost], return_inverse=True)
                found = self.lengths(fresh)
                lengths[lost] = found[where]
                to = (fresh.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift
                _, last = np.unique(to[::-1], return_index=True)  # of codes with one slot one is kept
                keep = len(to) - 1 - last
                self._keys[to[keep]], self._lengths[to[keep]] = fresh[keep], found[keep]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            out[rows[first]] += np.add.reduceat(lengths, first, 0, np.int64)
        return out / SCALE


def sample(docs: DataFrame, most: int = DOCS_A_LANGUAGE) -> DataFrame:
    """(lang, text) of the rows whose ids' hashes are within each language's share, so that about `most` remain; only counts are shuffled."""
    told = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("doc_id", "lang", "text")
    shares = told.groupBy("lang").agg(F.ceil(F.least(F.lit(1.0), most / F.count(F.lit(1))) * (1 << 30)).alias("_share"))
    shares = written(shares, "ppm-shares")
    chosen = told.join(F.broadcast(shares) if shares.count() <= FEW else shares, "lang")
    return chosen.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), F.lit(0)) < F.col("_share")).select("lang", "text")


def fit(docs: DataFrame, most: int = DOCS_A_LANGUAGE) -> Trees:
    """docs (doc_id, lang, text): the trees of its bounded sample."""
    small_batches(docs.sparkSession)

    def code_counts(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                raw, ends = text_bytes(b.column(1).filter(pa.array(langs == lang)))
                for codes, _ in windows(raw, ends):
                    code, n = np.unique(codes, return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    counted = sample(docs, most).mapInArrow(code_counts, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counted.toArrow().combine_chunks()  # at most the distinct codes of a bounded sample
    names = found.column("lang").to_numpy(zero_copy_only=False) if found.num_rows else np.zeros(0, object)
    code, n = (found.column(c).to_numpy().astype(np.int64) if found.num_rows else np.zeros(0, np.int64) for c in ("code", "n"))
    languages = sorted(set(names))
    parts = []
    for x in languages:
        mine = names == x
        order = np.argsort(code[mine])
        parts.append((code[mine][order], n[mine][order]))
    return Trees(languages, [c for c, _ in parts], [k for _, k in parts])


def judged(column, trees: Trees) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of an Arrow column."""
    raw, ends = text_bytes(column)
    letters = np.zeros(len(ends) - 1, bool)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        letters[some] = np.logical_or.reduceat(LETTER[raw], ends[some])
    for k in some[~letters[some]]:
        letters[k] = any(c.isalpha() for c in raw[ends[k] : ends[k + 1]].tobytes().decode("utf-8", "replace"))
    if not len(trees.languages) or not len(letters):
        return ["und"] * len(letters), np.zeros(len(letters))
    bits = trees.sums(raw, ends)
    best = bits.argmin(1)
    gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1, EVIDENCE / np.maximum(np.diff(ends), 1))[:, None]
    score = np.where(letters, 1 / np.exp2(-gap).sum(1), 0.0)
    return [trees.languages[b] if x else "und" for b, x in zip(best, letters)], score


def predicted(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs (doc_id, text): doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)

    def run(batches):
        model = trees.here()
        for b in batches:
            lang, score = judged(b.column(1), model)
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of a known language, with a score of FLOOR or more, stay; no shuffle of texts."""
    trees, at = fit(docs), docs.columns.index("text")

    def run(batches):
        model = trees.here()
        for b in batches:
            lang, score = judged(b.column(at), model)
            yield b.filter(pa.array([x != "und" and s >= FLOOR for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
