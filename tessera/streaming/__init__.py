"""Structured Streaming over the same tables: an extension beyond the query layer's own cursor (``Engine.stream``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows in each event-time window by key; works on a stream and on a table. Rows later than ``late`` are dropped on a stream."""
    timed = events.withColumn("__time", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__time", late)
    grouped = timed.groupBy(F.window("__time", size, slide or size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rows")
