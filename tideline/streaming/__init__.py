"""The hourly roll-up as a stream, for events that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """series_id, ts, x of a stream of events; an hour is final once the watermark passes it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.sum("value").alias("x")).select(F.col("event_type").alias("series_id"), F.col("window.start").alias("ts"), "x")
