"""Slicer selections that arrive as events: the latest of each user filters a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_selection(events: DataFrame, *, user: str = "user_id", at: str = "ts", item: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(user, item, at): what each user chose last; on a stream, state is kept per user and updated."""
    watched = events.withWatermark(at, late) if events.isStreaming else events
    return watched.groupBy(user).agg(F.max_by(item, F.struct(at, item)).alias("item"), F.max(at).alias("at"))


def windowed_counts(events: DataFrame, width: str, *, at: str = "ts", item: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(start, item, n) per tumbling window; on a stream, a window is final once the watermark passes it."""
    watched = events.withWatermark(at, late) if events.isStreaming else events
    return watched.groupBy(F.window(at, width).alias("w"), item).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), item, "n")
