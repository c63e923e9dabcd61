"""Event-time rollups over unbounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_rollup(events: DataFrame, time: str, keys: list[str], aggs: list[Column], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, keys and aggregates per tumbling window; rows later than the watermark are left out, state older than it is
    dropped, so state is bounded by the keys active within it. Works on streams and on tables alike."""
    grouped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(*aggs)
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def deduplicated(events: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """Repeated deliveries of an id within the watermark are dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
