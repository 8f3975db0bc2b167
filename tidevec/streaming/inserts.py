"""Streams: bucketing by event time, and inserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """bucket, event_type, n per window of event time; on a stream, rows later than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("bucket"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n per session of a user."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def insert_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch is one insert; a batch that is repeated after a failure comes with the same number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
