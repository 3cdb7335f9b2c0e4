"""Submission bursts per shared entity, over a batch or a streaming table.

As a stream each function appends a window once the watermark has passed its end, so state holds open windows only.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window


def burst_windows(
    events: DataFrame, key: str, event_time: str, length: str = "1 hour", slide: str | None = "15 minutes",
    lateness: str = "1 hour",
) -> DataFrame:
    """Submissions per key and window: sliding, or tumbling without ``slide``."""
    if events.isStreaming:
        events = events.withWatermark(event_time, lateness)
    frame = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    counted = events.groupBy(key, frame).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def bursts(windows: DataFrame, at_least: int) -> DataFrame:
    return windows.where(F.col("n") >= at_least)


def burst_sessions(events: DataFrame, key: str, event_time: str, gap_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Runs of submissions with no pause of ``gap_seconds`` or more: first and last moment in microseconds, and their number.

    A stream keeps its open sessions as state, merged by session window. In a batch, events of one key inside one slot of the gap's length always share a session. So they are first
    combined to one row per slot, map-side, and only those rows are ordered: a key's group is then
    bounded by the time covered, not by its number of events.
    """
    if events.isStreaming:
        return _streaming_sessions(events, key, event_time, gap_seconds, lateness)
    time = F.col(event_time).cast(T.TimestampType())
    micros = F.unix_micros(time)
    gap = gap_seconds * 1_000_000
    slots = events.select(key, micros.alias("at")).groupBy(key, F.floor(F.col("at") / gap).alias("slot")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy(key).orderBy("slot")
    starts = (F.col("first") - F.lag("last").over(order)) >= gap
    numbered = slots.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(
        "session", F.sum("starts").over(order)
    )
    return numbered.groupBy(key, "session").agg(
        F.min("first").alias("first_micros"), F.max("last").alias("last_micros"), F.sum("n").alias("n")
    )


def _streaming_sessions(events: DataFrame, key: str, event_time: str, gap_seconds: int, lateness: str) -> DataFrame:
    # Sessions whose ends touch are merged, so a pause of exactly the gap needs the last microsecond taken off.
    pause = gap_seconds * 1_000_000 - 1
    frame = F.session_window(event_time, f"{pause} microseconds")
    counted = events.withWatermark(event_time, lateness).groupBy(key, frame).agg(F.count(F.lit(1)).alias("n"))

    def micros(end: str):
        return F.unix_micros(F.col(f"session_window.{end}").cast(T.TimestampType()))

    # A session's window ends one pause after its last event.
    return counted.select(key, micros("start").alias("first_micros"), (micros("end") - pause).alias("last_micros"), "n")
