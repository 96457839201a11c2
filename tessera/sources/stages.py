"""Stage tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a local session gets a folder of its own; a cluster must name one."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop's objects."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def address(spark: SparkSession, path: str) -> str:
    """A folder, made if it is not there, as a path or address that Arrow's file systems open."""
    there, files = _path(spark, path)
    files.mkdirs(there)
    whole = files.makeQualified(there).toUri()
    return whole.getPath() if whole.getScheme() == "file" else whole.toString()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for files that are more than one table; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there, files = _path(spark, path)
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again; the files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there, files = _path(spark, path)
    files.deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """What a table holds, whatever its rows' order: their number and the sum of their hashes."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.sum(row)).first()
    return f"{n}-{total or 0}"


def inputs_of(spark: SparkSession, path: str) -> str:
    """What the stage at path was made from, as it was told; empty if it was not."""
    there, files = _path(spark, f"{path}/_inputs")
    if not files.exists(there):
        return ""
    stream = files.open(there)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def stage(spark: SparkSession, path: str, make, inputs: str = "") -> DataFrame:
    """The table at path if it is complete and was made from the same inputs (a fingerprint), else made, written and read: a later run resumes at the first missing stage."""
    done, files = _path(spark, f"{path}/_SUCCESS")
    if not files.exists(done) or inputs_of(spark, path) != inputs:
        make().write.mode("overwrite").parquet(path)
        if inputs:
            stream = files.create(_path(spark, f"{path}/_inputs")[0])
            stream.writeUTF(inputs)
            stream.close()
    return spark.read.parquet(path)
