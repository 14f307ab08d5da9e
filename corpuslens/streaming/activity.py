"""Extension: the same activity measures over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream's event time as a timestamp with its watermark; a batch as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed_activity(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events in tumbling windows; later than `late` is dropped by the watermark (streams only)."""
    return _timed(events, ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "events")


def session_activity(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sessions of a user: a pause of `gap` ends one (a streak, for a gap of a day)."""
    return _timed(events, ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
