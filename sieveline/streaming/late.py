"""Rows that arrive twice or late, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, keys: list[str], event_time: str, delay: str = "7 days") -> DataFrame:
    """Each key once; state is dropped ``delay`` after the event time, so repeats later than that pass again."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, kind: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, kind, n) per tumbling window of event time."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), kind).count().select(F.col("window.start").alias("start"), kind, F.col("count").alias("n"))
