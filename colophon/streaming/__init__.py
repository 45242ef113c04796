"""Streaming forms of the operators whose state is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, key: str, time: str, window: str, late: str) -> DataFrame:
    """Events by key and tumbling window; state older than ``late`` is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
