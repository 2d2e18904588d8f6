"""Trailing windows over event streams: the batch aggregates' streaming form, the same plan for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sliding_totals(events: DataFrame, time: str, key: str, value: str, length: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, n, total) of each window; on a stream, state is dropped once the watermark has passed a window."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, length, slide)
    return df.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")
