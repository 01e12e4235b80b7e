"""Event-time windows over streams and batches of (ts, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; on a stream, ``late`` bounds how long a window stays open."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's sessions: runs of events with less than ``gap`` between them."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """On a stream: one row for each key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
