"""Streaming bars: an extension of the batch bars with event-time windows and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, interval: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLCV per event type and window; rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    key = F.struct("ts", "event_id")
    return (
        timed.groupBy(F.window("ts", interval), F.col("event_type").alias("dataset_id"))
        .agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("dataset_id", F.unix_millis("window.start").alias("ts_ms"), "open", "high", "low", "close", "volume")
    )
