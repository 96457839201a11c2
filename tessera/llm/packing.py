"""Operator 5, best-fit packing of tokenised documents into sequences, by sum of squares.

A document is the ids of its text and an end id. Documents longer than a sequence are cut into whole
sequences' length, the first piece taking what is over. Pieces are dealt by a hash of the document into shards of about
SHARD pieces; each shard packs its pieces, longest first: a piece goes where the sum over residual gaps of
(open sequences with that gap) squared becomes least; a sequence is opened where no open one has room. A shard's state is one counter a gap, its memory its
pieces' numbers; ids never leave the task that made them, only lengths and checksums are shuffled.

Null and empty texts are the end id alone. Ties among gaps go to the smaller gap, among pieces to the lesser id
and piece. Repeated rows are each packed. An empty table gives an empty result; other columns are not read.

Texts are tokenised by `tokenizers`. As its pre-tokeniser never joins across a single space, every
chunk between single spaces is encoded once a worker and looked up afterwards; texts in which white space
follows white space are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, trimmed, written

LENGTH, END, SHARD, MOST_CHUNKS = 1024, 2, 16384, 600_000
#: How byte-level tokens write a space; chunks encoded by one call.
SPACE, GROUP = "\u0120", 64
DOUBLE_SPACE = re.compile(r"\s\s")


class _Chunks(dict):
    """Chunk to number; a chunk that is asked for anew is numbered and noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = k = len(self)
        return k


class Encoder:
    """Ids of texts by a tokenizer file, with a bounded memory of chunks."""

    def __init__(self, path: str, most: int = MOST_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[k for token, k in vocabulary.items() if token.startswith(SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.starts, self.sizes, self.flat, self.used = _Chunks(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _learn(self) -> None:
        fresh, self.chunks.fresh = self.chunks.fresh, []
        if not fresh:
            return
        # A text's first chunk has no space before it: it is kept under a mark that no other chunk can have.
        heads = [k for k, x in enumerate(fresh) if x.startswith("\n\n")]
        rest = [k for k, x in enumerate(fresh) if not x.startswith("\n\n")]
        one, one_sizes = self._ids([fresh[k] for k in rest])
        two = self._batch([fresh[k][2:] for k in heads])
        two_sizes = np.fromiter(map(len, two), np.int64, len(two))
        new = np.concatenate([one, np.fromiter(chain.from_iterable(two), np.int64)]).astype(np.uint32)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        where, stored = np.array(rest + heads), np.concatenate([one_sizes, two_sizes])
        sizes, starts = np.empty(len(fresh), np.int64), np.empty(len(fresh), np.int64)
        sizes[where], starts[where] = stored, self.used + np.cumsum(stored) - stored
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.used += len(new)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that follow a space, and how many each has.

        GROUP chunks are encoded by one call, as calls cost more than their work; a chunk's ids begin with the one that holds its space.
        """
        ids = self._batch([" " + " ".join(chunks[k : k + GROUP]) for k in range(0, len(chunks), GROUP)])
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        starts = np.flatnonzero(self.spaced[flat])
        if len(starts) == len(chunks) and not (len(starts) and starts[0]):
            return flat, np.diff(np.append(starts, len(flat)))
        ids = self._batch([" " + x for x in chunks])
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > self.most:
            self._forget()
        numbers, counts, whole = [], [], {}
        get = self.chunks.__getitem__
        for k, text in enumerate(texts):
            if not text:
                counts.append(0)
            elif DOUBLE_SPACE.search(text):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                counts.append(0)
            else:
                first, *rest = text.split(" ")
                part = list(map(get, rest))
                if first:
                    part.insert(0, get("\n\n" + first))
                numbers += part
                counts.append(len(part))
        self._learn()
        which = np.array(numbers, np.int64)
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return [whole[k] if k in whole else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """docs (doc_id, text): doc_id, piece, start, length, ids_crc32 of every piece; no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for ident, ids in zip(b.column(0).to_pylist(), encoder(path).encode(b.column(1).to_pylist())):
                ids = np.append(ids, end).astype("<u4")
                at, size, k = 0, (len(ids) - 1) % length + 1, 0
                while at < len(ids):
                    rows.append((ident, k, at, size, zlib.crc32(ids[at : at + size])))
                    at, size, k = at + size, length, k + 1
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(sizes: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, placed in the order given; room: a bin's size. A bin is opened where none has room."""
    count = np.zeros(room + 1, np.int64)  # open bins by gap
    open_: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    shut = np.int64(1 << 60)
    for k, s in enumerate(sizes.tolist()):
        there = count[s:room]
        if there.any():
            # Change of the sum if a bin of gap g (from s on) becomes one of gap g - s; a full one counts no more.
            change = np.where(there > 0, 2 * (count[: room - s] - there) + 2, shut)
            if there[0] > 0:
                change[0] = 1 - 2 * there[0]
            gap = s + int(change.argmin())
            count[gap] -= 1
            own = open_[gap].pop()
        else:
            gap, own, made = room, made, made + 1
        bins[k], offsets[k] = own, room - gap
        if gap > s:
            count[gap - s] += 1
            open_[gap - s].append(own)
    return bins, offsets


def packed(parts: DataFrame, shards: int, length: int = LENGTH) -> DataFrame:
    """parts (doc_id, piece, length, and others): adds sequence_id and offset."""

    def run(group: pa.Table) -> pa.Table:
        size, ident, piece = (group.column(c).to_numpy() for c in ("length", "doc_id", "piece"))
        order = np.lexsort((piece, ident, -size))
        bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offsets[order] = sum_of_squares(size[order], length)
        shard = group.column("shard")[0].as_py()
        return group.drop_columns("shard").append_column("sequence_id", pa.array(bins + (shard << 32))).append_column("offset", pa.array(offsets))

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.groupBy("shard").applyInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, shard: int = SHARD) -> DataFrame:
    parts = written(pieces(docs, path, length, end), "pack-pieces")
    return packed(parts, max(1, -(-parts.count() // shard)), length)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each piece of each document goes."""
    return pack(docs, tokenizer_path())
