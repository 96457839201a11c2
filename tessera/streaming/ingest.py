"""Facts that arrive as a stream: windowed counts with late data, and incremental append to a layer's table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """events (ts, event_type, value): counts and sums by window and type; later rows than `lateness` are dropped by the watermark."""
    timed = events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type")
    return timed.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends rows, once each by event_id within the watermark, to a Parquet table."""
    once = events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
