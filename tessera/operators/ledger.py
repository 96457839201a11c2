"""Answers of paid or slow calls, kept in a shared table: equal prompts are asked once, and no answer is asked for twice, whatever is lost or run again.

The ledger is a folder of Parquet files by shard (a hash of the prompt). A task that answers a shard reads what the folder has of it, asks for the rest, and writes
every few answers to a new file as they come. A task that is lost leaves its files, and whoever takes its place asks only for what they lack; so does a later
run. Failed calls are not kept, and are asked again by the next run.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import address, written

#: Shards of a ledger; answers between two files.
SHARDS, FLUSH = 256, 20
SCHEMA = "key string, response string, prompt_tokens bigint, completion_tokens bigint"

_made: dict[str, object] = {}


class OncePerWorker:
    """A function that `make` gives, made at its first call in a Python worker and kept for all its tasks: for clients, models and tokenizers.

    What is sent to the workers is `make` alone. Two handles of one name share what is made.
    """

    def __init__(self, name: str, make: Callable[[], Callable]):
        self.name, self.make = name, make

    def __call__(self, *args, **more):
        if self.name not in _made:
            _made[self.name] = self.make()
        return _made[self.name](*args, **more)


def tried(model: Callable, asked: tuple[str, str], response_schema: str | None, retries: int, pause: float) -> tuple:
    """(response, prompt tokens, completion tokens, error) of a call, tried again after pauses that double."""
    for k in range(retries + 1):
        try:
            return (*model(*asked, response_schema), None)
        except Exception as e:  # the row keeps what went wrong
            if k == retries:
                return None, 0, 0, str(e)
            time.sleep(pause * 2**k)


def key_of(response_schema: str | None, name: str):
    """A prompt's key: a hash of what is asked, of the answer's schema and of who is asked."""
    part = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    return F.sha2(F.concat(*[part(F.coalesce(x, F.lit(""))) for x in (F.col("system"), F.col("user"), F.lit(response_schema or ""), F.lit(name))]), 256)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers of the ledger, once each: key, response, token counts. Their sums are what was paid for."""
    rows = spark.read.schema(f"{SCHEMA}, shard int").parquet(path)
    return rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("response", "prompt_tokens", "completion_tokens")])


def ask(prompts: DataFrame, model: Callable, path: str, response_schema: str | None = None, name: str = "", retries: int = 0, at_once: int = 1, pause: float = 1.0, flush: int = FLUSH, shards: int = SHARDS) -> DataFrame:
    """prompts (system, user, and others): adds response, prompt_tokens, completion_tokens, error, from the ledger at path where it has them.

    Null prompts count as empty. Rows of one prompt share its answer and show its tokens each. `name` tells models apart.
    """
    spark, place = prompts.sparkSession, address(prompts.sparkSession, path)
    keyed = prompts.withColumn("_key", key_of(response_schema, name))
    missing = keyed.groupBy("_key").agg(F.first(F.coalesce("system", F.lit(""))).alias("system"), F.first(F.coalesce("user", F.lit(""))).alias("user"))
    missing = missing.withColumn("shard", F.pmod(F.xxhash64("_key"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(place)
        known: dict[int, set] = {}

        def kept(shard: int) -> set:
            """Keys of the shard's files; of one shard after the other, as rows come in their order."""
            if shard not in known:
                known.clear()
                store.create_dir(f"{base}/shard={shard}", recursive=True)
                files = [f.path for f in store.get_file_info(fs.FileSelector(f"{base}/shard={shard}")) if f.path.endswith(".parquet")]
                known[shard] = {key for f in files for key in pq.read_table(f, columns=["key"], filesystem=store).column(0).to_pylist()}
            return known[shard]

        def keep(shard: int, found: list[tuple]) -> None:
            """A file that is whole once it has its name."""
            table = pa.table(dict(zip(("key", "response", "prompt_tokens", "completion_tokens"), (pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.string(), pa.int64(), pa.int64()))))))
            file = f"{base}/shard={shard}/_{uuid.uuid4().hex}"
            pq.write_table(table, file, filesystem=store)
            store.move(file, file.replace("/_", "/") + ".parquet")

        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for b in batches:
                failed = []
                for shard, group in b.groupby("shard", sort=False):
                    rest = group[~group["_key"].isin(kept(shard))]
                    step = max(flush, 1)
                    for lo in range(0, len(rest), step):
                        part = rest.iloc[lo : lo + step]
                        got = list(pool.map(lambda x: tried(model, x, response_schema, retries, pause), zip(part["system"], part["user"])))
                        if good := [(k, *x[:3]) for k, x in zip(part["_key"], got) if x[3] is None]:
                            keep(shard, good)
                            kept(shard).update(x[0] for x in good)
                        failed += [(k, x[3]) for k, x in zip(part["_key"], got) if x[3] is not None]
                yield pd.DataFrame(failed, columns=["_key", "error"])

    tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    errors = missing.repartition(tasks, "shard").sortWithinPartitions("shard").mapInPandas(run, "_key string, error string")
    errors = written(errors, "ledger-errors")  # the calls run here, once
    known = answers(spark, path).withColumnRenamed("key", "_key")
    out = keyed.join(known, "_key", "left").join(errors, "_key", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("prompt_tokens", "completion_tokens")}).select(*prompts.columns, "response", "prompt_tokens", "completion_tokens", "error")
