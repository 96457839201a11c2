"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import shared_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a path or address that Arrow's file systems open; it goes when the session's JVM ends."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(there)
    files.deleteOnExit(there)
    address = files.makeQualified(there).toUri()
    return address.getPath() if address.getScheme() == "file" else address.toString()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows of the session's Arrow batches, as single texts may be very long; plans read the setting when they run, so it stays."""
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if int(now) > rows or int(now) <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed(run):
    """A task over Arrow batches that gives the memory it has freed back to the system at its end, as workers live on."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
            library.malloc_trim(0)

    return whole


def ascii_lower(col):
    """Lower-cases A-Z alone."""
    return F.translate(col, UPPER, LOWER)


def held_out(col="doc_id"):
    """True for rows whose crc32 of the id as text leaves 2 modulo 4; they teach nothing."""
    return F.crc32(F.col(col).cast("string")) % 4 == 2
