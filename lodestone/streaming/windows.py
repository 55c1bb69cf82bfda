"""Hourly event windows, as a batch and as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """(hour, event_type, events, total). late: on a stream, how late rows may come."""
    if late is not None:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("hour"), "event_type", "events", "total")
