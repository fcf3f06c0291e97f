"""Event-time windows over change streams, an addition to what a log gateway has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows; with a stream, rows later than ``late`` are left out."""
    kept = events.withWatermark(ts, late) if events.isStreaming else events
    return kept.groupBy(F.window(ts, width, slide), *by).agg(F.count("*").alias("n_events")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n_events")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    kept = events.withWatermark(ts, late) if events.isStreaming else events
    return kept.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n_events")).select(F.col("session_window.start").alias("session_start"), by, "n_events")


def size_or_time_batches(events: DataFrame, ts: str, order: str, size: int, seconds: int) -> DataFrame:
    """Events with the ``batch_start`` and ``part`` of a buffer that is flushed every ``seconds``, and before that whenever it holds ``size``."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds)
    numbered = events.withColumn("batch_start", start).withColumn("__k", F.row_number().over(Window.partitionBy("batch_start").orderBy(order)))
    return numbered.withColumn("part", F.floor((F.col("__k") - 1) / size)).drop("__k")
