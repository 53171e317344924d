"""Debounced input: of events that follow each other within the delay only the last counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str, value: str, delay: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """(key, fired, value): the last value of each burst of a key, for tables and, with a watermark, for streams."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    bursts = events.groupBy(F.col(key), F.session_window(ts, delay).alias("burst")).agg(F.max_by(value, ts).alias(value))
    return bursts.select(key, F.col("burst.end").alias("fired"), value)
