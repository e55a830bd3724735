"""Windowed aggregates of an event stream, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, window_end, keys, n, total; works on a stream and on a table alike."""
    w = F.window(F.col(time).cast("timestamp"), width, slide) if slide else F.window(F.col(time).cast("timestamp"), width)
    source = events.withColumn(time, F.col(time).cast("timestamp"))
    if source.isStreaming:
        source = source.withWatermark(time, late)
    out = source.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def latest_by_key(events: DataFrame, time: str, key: str, value: str) -> DataFrame:
    """key, latest, value at it: the running state of each key, in update or complete mode on a stream."""
    return events.groupBy(key).agg(F.max(time).alias("latest"), F.max_by(value, time).alias(value))
