"""Sessions of event logs, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = 3600) -> DataFrame:
    """Adds ``session`` (from 1): a gap of ``gap_seconds`` or more opens a new one."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    opens = F.when(gap.isNull() | (gap >= gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def session_sizes(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = 3600) -> DataFrame:
    """Per session its start, end and number of events."""
    return sessions(events, user, ts, gap_seconds).groupBy(user, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))


def streamed_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """The same for a stream, with a watermark for late events.

    The engine merges events exactly a gap apart, the batch form opens a session there; with the
    gap one microsecond shorter both agree.
    """
    gap = f"{gap_seconds - 1}.999999 seconds"
    window = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(F.col(user), window.alias("w")).agg(F.count("*").alias("n_events")).select(user, F.col("w.start").alias("started"), "n_events")
