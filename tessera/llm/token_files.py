"""Operator 13, token ids as flat binary files with 64-bit document offsets, read by memory maps.

A folder holds shards, which follow each other in ascending order of id. A shard is three flat little-endian files:

* `.ids`: all ids of its documents, one after the other, as unsigned integers: 16 bits where the vocabulary allows, else 32;
* `.offsets`: for each document where its ids begin in `.ids`, and where the last ends, as unsigned 64-bit integers;
* `.docs`: the documents' ids as signed 64-bit integers.

The manifest, a table, has a row a shard: files, counts, and its bases, that is documents and ids of all shards before it. Bases are
prefix sums in two levels over shards' totals, so that a document's place in the whole is its shard's base plus its offset.

Texts are encoded where they are read, and only ids are shuffled. Shards are ranges of document ids, by quantiles of all ids (a sketch of
bounded size, at most MOST_SHARDS bounds). An id that fills whole ranges is dealt over as many shards. Tasks stream their shards in order of id,
holding one batch. Files are named by attempt: a task that is run again writes others, and the manifest names those of the attempt that ended
well. Files are written to and read from the folder that the cluster shares (any file system that Arrow knows; memory maps where it is mounted,
ranged reads elsewhere).

Null and empty texts are the end id alone. Null document ids come first (a shard knows how many it has); rows of one id follow each
other, by their ids. An empty table gives no shard and an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, table, trimmed, written
from .packing import encoder, tokenizer_path

END, SHARD_ROWS, LEAST_ROWS, MOST_SHARDS, BLOCK = 0, 65_536, 1024, 65_536, 1024
NULL = -(1 << 63)  # where null ids lie among others
MANIFEST = "shard int, path string, kind string, docs bigint, nulls bigint, tokens bigint"


def id_type(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = END, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (doc_id, text) as shards in folder (an address that all executors reach): their manifest, with base_docs and base_tokens."""
    spark = docs.sparkSession
    count = docs.count()
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(MOST_SHARDS, max(-(-count // shard_rows), min(wide, -(-count // LEAST_ROWS)), 1))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    place = F.coalesce("doc_id", F.lit(NULL))
    cuts = rows.agg(F.percentile_approx(place, [k / shards for k in range(1, shards)], 10 * shards)).first()[0] if shards > 1 else []
    cuts = np.array(cuts or [], np.int64)  # at most MOST_SHARDS
    kind = id_type(tokenizer)
    small_batches(spark)

    def deal(batches):
        turn = 0
        for b in batches:
            ids = b.column(0).fill_null(NULL).to_numpy(zero_copy_only=False)
            low, high = (np.searchsorted(cuts, ids, side) for side in ("left", "right"))
            # An id that is the bound of several shards is dealt over those in turn; other ids have one shard.
            at = high - (turn + np.arange(len(ids))) % np.maximum(high - low, 1)
            turn += len(ids)
            blobs = [np.append(x, end).astype(kind).tobytes() for x in encoder(tokenizer).encode(b.column(1).to_pylist())]
            yield pa.record_batch([pa.array(at, pa.int32()), b.column(0), pa.array(blobs, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches):
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        now, files, path, total, docs_, nulls, fresh = None, [], "", 0, 0, 0, []

        def close():
            for f in files:
                f.close()
            return [(now, path, kind, docs_, nulls, total)] if files else []

        for b in batches:
            done = []
            shard, ids, blobs = b.column(0).to_numpy(), b.column(1), b.column(2).to_pylist()
            for lo, hi in _runs(shard):
                if shard[lo] != now:
                    done += close()
                    now, total, docs_, nulls = int(shard[lo]), 0, 0, 0
                    path = f"{base}/{now:08d}-{uuid.uuid4().hex}"
                    files = [target.open_output_stream(path + end_) for end_ in (".ids", ".offsets", ".docs")]
                    files[1].write(np.zeros(1, "<u8").tobytes())
                sizes = np.array([len(x) for x in blobs[lo:hi]], np.int64) // np.dtype(kind).itemsize
                files[0].write(b"".join(blobs[lo:hi]))
                files[1].write((total + np.cumsum(sizes)).astype("<u8").tobytes())
                files[2].write(ids[lo:hi].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                total, docs_, nulls = total + int(sizes.sum()), docs_ + hi - lo, nulls + ids[lo:hi].null_count
            if done:
                yield _manifest(done)
        if last := close():
            yield _manifest(last)

    dealt = rows.mapInArrow(trimmed(deal), "shard int, doc_id bigint, ids binary")
    files = dealt.repartition(max(wide, shards), "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(write, MANIFEST)
    return based(written(files, "token-shards"))  # once: a second run would write other files


def based(rows: DataFrame) -> DataFrame:
    """Shards' totals: adds base_docs and base_tokens, the sums over all shards before; in two levels, so that no task has all shards."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_block", F.floor(F.col("shard") / BLOCK).cast("int"))
    inside = before(Window.partitionBy("_block").orderBy("shard"))
    # MOST_SHARDS / BLOCK rows.
    blocks = rows.groupBy("_block").agg(F.sum("docs").alias("_docs"), F.sum("tokens").alias("_tokens"))
    ahead = before(Window.orderBy("_block"))
    blocks = blocks.select("_block", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in ("docs", "tokens")])
    out = rows.join(F.broadcast(blocks), "_block")
    bases = {f"base_{c}": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("docs", "tokens")}
    return out.withColumns(bases).drop("_block", "_docs", "_tokens")


def _runs(values: np.ndarray):
    """Begin and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return zip(np.append(0, cut), np.append(cut, len(values))) if len(values) else []


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in MANIFEST.split(", ")])


class Shard:
    """One shard, opened: documents by number, ids as views of the map."""

    def __init__(self, folder: str, path: str, kind: str):
        source, _ = fs.FileSystem.from_uri(folder)
        self.kind, self.local = kind, isinstance(source, fs.LocalFileSystem)
        self.offsets, self.docs = self._all(source, path + ".offsets", "<u8"), self._all(source, path + ".docs", "<i8")
        self.ids = self._all(source, path + ".ids", kind) if self.local else source.open_input_file(path + ".ids")

    def _all(self, source, path: str, kind: str) -> np.ndarray:
        if self.local:
            return np.memmap(path, kind, "r") if source.get_file_info(path).size else np.zeros(0, kind)
        with source.open_input_stream(path) as f:
            return np.frombuffer(f.read(), kind)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, k: int) -> np.ndarray:
        lo, hi = int(self.offsets[k]), int(self.offsets[k + 1])
        if self.local:
            return self.ids[lo:hi]
        size = np.dtype(self.kind).itemsize
        return np.frombuffer(self.ids.read_at((hi - lo) * size, lo * size), self.kind)


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_tokens(manifest: DataFrame, folder: str, each=None, schema: str = READ, rows: int = 4096) -> DataFrame:
    """Documents of the manifest's shards, from their files; each(doc_id, start, ids) gives a row of `schema`, by default lengths and checksums."""
    each = each or (lambda ident, start, ids: (ident, start, len(ids), zlib.crc32(ids.astype("<u4"))))
    fields = pa.schema([(x.split()[0], {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")])

    def run(batches):
        for b in batches:
            for m in b.to_pylist():
                shard = Shard(folder, m["path"], m["kind"])
                for lo in range(0, len(shard), rows):
                    found = [each(int(shard.docs[k]) if k >= m["nulls"] else None, m["base_tokens"] + int(shard.offsets[k]), shard[k]) for k in range(lo, min(lo + rows, len(shard)))]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), fields)], schema=fields)

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(tasks, "shard").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), folder), folder)
