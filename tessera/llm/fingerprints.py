"""Operator 10, document fingerprints: homomorphic multiset hashes of paragraphs.

A text is the multiset of its paragraphs (lines that are not blank). Each paragraph is hashed to wide vectors, and a
text's fingerprint is their sum, so that order does not matter and paragraphs can be inserted or
deleted by adding or subtracting theirs. It has two parts:

* LANES words of 64 bits, summed modulo 2**64: equal if (up to collisions) the multisets are equal;
* SKETCH lanes, summed modulo 2**32: every run of GRAM bytes of a paragraph (together with how often the same run
  came before it in the paragraph) adds +1 or -1 to one lane; the cosine of two such sums estimates the share of common runs.

One rule for paragraphs of all lengths, and long ones weigh by their length. Likeness is 1 for equal multisets, else the
cosine, within 0 to 1: the first part tells equal from unequal, near and far come from the second alone. A fingerprint is
written in base 64, both parts little-endian. Null texts count as empty: no paragraph, all zeros; likeness of two
empty texts is 1, of an empty and another text 0. Paragraphs over BLOCK bytes are sketched in pieces of BLOCK bytes, so that memory
is bounded.

`edited` pairs every text with the next one by id without a single ordered task: rows (texts compressed)
are dealt by ranges of ids, the first row of each range also goes to the range before it, and a task
streams its ranges in order of id, holding two texts at a time. Repeated ids follow each other,
in order of their packed text; the last row's next is the first. Rows of null ids come first. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .shingles import A, C, P, mix

LANES, SKETCH, GRAM, BLOCK = 8, 256, 8, 1 << 20
#: Rows a range, and ranges at most: their bounds are all that the driver holds. Ranges are streamed, two texts at a time.
RANGE_ROWS, MOST_RANGES = 500, 65_536


def paragraphs(text: str) -> list[str]:
    return [x for x in (p.strip() for p in text.split("\n")) if x]


def wide(paragraph: str) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(paragraph.encode(), digest_size=8 * LANES, person=b"multiset").digest(), np.uint64)


def lanes_of(raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Lane sums of paragraphs given as bytes, each followed by GRAM - 1 bytes of padding, and their sizes without it."""
    n = len(raw) - GRAM + 1
    x = raw.astype(np.uint64) + np.uint64(1)
    h = x[:n].copy()
    for k in range(1, GRAM):
        h = h * P + x[k : n + k]
    inside = np.ones(len(raw), bool)
    ends = np.cumsum(sizes + GRAM - 1) - (GRAM - 1)
    inside[(ends[:, None] + np.arange(GRAM - 1)).ravel()] = False
    h = mix(h[inside[:n]])
    key = mix(h ^ (np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) * C))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    again = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    h = mix(h[order] + again.astype(np.uint64) * A)
    return np.bincount((h >> np.uint64(56)).astype(np.int64), 1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64), SKETCH).astype(np.int64)


def signs(some: list[str]) -> np.ndarray:
    """Lane sums of paragraphs, about BLOCK bytes at once."""
    total, parts, held = np.zeros(SKETCH, np.int64), [], 0
    pieces = [raw[k : k + BLOCK] for raw in (p.encode() for p in some) for k in range(0, len(raw), BLOCK)]
    for k, piece in enumerate(pieces):
        parts.append(piece)
        held += len(piece)
        if held >= BLOCK or k == len(pieces) - 1:
            raw = np.frombuffer(b"".join(x + bytes(GRAM - 1) for x in parts), np.uint8)
            total += lanes_of(raw, np.array([len(x) for x in parts]))
            parts, held = [], 0
    return total


class Fingerprint:
    """The sums over a multiset of paragraphs; `add` and `remove` change it in place."""

    def __init__(self, some: list[str] = ()):
        self.words, self.sketch = np.zeros(LANES, np.uint64), np.zeros(SKETCH, np.uint32)
        self.add(some)

    def _change(self, some: list[str], sign: int) -> None:
        if some:
            words = np.add.reduce([wide(p) for p in some])
            sketch = signs(some).astype(np.uint32)
            self.words = self.words + words if sign > 0 else self.words - words
            self.sketch = self.sketch + sketch if sign > 0 else self.sketch - sketch

    def add(self, some: list[str]) -> None:
        self._change(some, 1)

    def remove(self, some: list[str]) -> None:
        self._change(some, -1)

    def copy(self) -> Fingerprint:
        out = Fingerprint()
        out.words, out.sketch = self.words.copy(), self.sketch.copy()
        return out

    def likeness(self, other: Fingerprint) -> float:
        if (self.words == other.words).all():
            return 1.0
        a, b = (x.sketch.view(np.int32).astype(np.float64) for x in (self, other))
        norm = np.sqrt((a * a).sum() * (b * b).sum())
        return float(min(1.0, max(0.0, (a * b).sum() / norm))) if norm else 0.0

    def text(self) -> str:
        return base64.b64encode(self.words.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).decode()


def of_text(text: str | None) -> Fingerprint:
    return Fingerprint(paragraphs(text or ""))


def edit(text: str, after: str) -> str:
    """text, the last quarter of its code points replaced by the first as many of `after`."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def of_edit(print_: Fingerprint, text: str, changed: str) -> Fingerprint:
    """The edited text's fingerprint from the text's: paragraphs behind the common ones are removed and added."""
    out = print_.copy()
    same = min(len(text) - len(text) // 4, len(changed))
    at = text.rfind("\n", 0, same) + 1  # the same in both: whole lines before it are common
    out.remove(paragraphs(text[at:]))
    out.add(paragraphs(changed[at:]))
    return out


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id and fingerprint; no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([of_text(x).text() for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def _edits(batches):
    """Rows of some ranges in order: range, doc_id, whether a copy of the next range's first row, text."""
    held: tuple | None = None
    rows: list[tuple] = []

    def pair(text: str, own: Fingerprint, after: str, follows: Fingerprint, ident) -> None:
        changed = edit(text, after)
        other = of_edit(own, text, changed)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        rows.append((ident, len(text), digest, own.text(), other.text(), own.likeness(other), own.likeness(follows)))

    def batch():
        nonlocal rows
        cols, rows = list(zip(*rows)) or [()] * 7, []
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in OUT.split(", ")])

    for b in batches:
        for span, ident, ghost, blob in zip(*(b.column(k).to_pylist() for k in range(4))):
            text = zstandard.decompress(blob).decode() if blob else ""
            own = of_text(text)
            if held is not None and held[0] == span:
                pair(held[2], held[3], text, own, held[1])
            held = None if ghost else (span, ident, text, own)
        yield batch()


def edited(docs: DataFrame, range_rows: int = RANGE_ROWS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """docs (doc_id, text): the columns of OUT for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    count = docs.count()
    spans = min(most_ranges, max(1, -(-count // range_rows)))
    # Bounds of about equal counts: quantiles of ids, a sketch of bounded size.
    cuts = docs.agg(F.percentile_approx("doc_id", [k / spans for k in range(1, spans)], 10 * spans)).first()[0] if spans > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def spans_of(ids) -> np.ndarray:
        return np.where(ids.is_null(), 0, np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right"))

    def least(batches):
        found: dict[int, tuple] = {}
        for b in batches:
            for s, x in zip(spans_of(b.column(0)).tolist(), b.column(0).to_pylist()):
                now = found.get(s)
                found[s] = (x is None or bool(now and now[0]), x if now is None or now[1] is None else now[1] if x is None else min(now[1], x))
        cols = list(zip(*((s, *x) for s, x in found.items()))) or [()] * 3
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.bool_(), pa.int64()))], ["span", "nulls", "first"])

    firsts = docs.select("doc_id").mapInArrow(least, "span bigint, nulls boolean, first bigint")
    firsts = firsts.groupBy("span").agg(F.max("nulls").alias("nulls"), F.min("first").alias("first")).orderBy("span").collect()  # at most most_ranges rows
    order = [r["span"] for r in firsts]
    lead = {r["span"]: None if r["nulls"] else r["first"] for r in firsts}
    before = {s: order[k - 1] for k, s in enumerate(order)}

    def deal(batches):
        pack = zstandard.ZstdCompressor(1)
        for b in batches:
            out = []
            for ident, text, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), spans_of(b.column(0)).tolist()):
                blob = pack.compress(text.encode()) if text else b""
                out.append((s, ident, False, blob))
                if ident == lead[s]:
                    out.append((before[s], ident, True, blob))
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["span", "doc_id", "ghost", "blob"])

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "span bigint, doc_id bigint, ghost boolean, blob binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spans // 4)
    return dealt.repartition(tasks, "span").sortWithinPartitions("span", "ghost", "doc_id", "blob").mapInArrow(_edits, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
