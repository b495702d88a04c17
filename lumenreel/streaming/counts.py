"""Incremental interaction counts: the item popularity of a stream of events, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n and value of each window; works on streams and tables alike. Rows later than late are dropped by a stream."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = ts.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "value")
