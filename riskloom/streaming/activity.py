"""Windowed activity, sessions and de-duplication on event streams.

The input has event_id, ts (timestamp), user_id and, for activity counts, activity. The functions
of one name take batch or stream frames alike unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import flag
from ..operators.events import resolve_events, row_features
from ..operators.joins import lookup_join
from ..operators.logs import after_hours
from ..operators.ordering import running_totals
from ..session import scratch_path


def run_to_folder(stream: DataFrame, name: str) -> str:
    """Process what is available now into parquet in the scratch folder; returns the data path."""
    path = scratch_path(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/data").option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{path}/data"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """The same, read back as a table."""
    return stream.sparkSession.read.schema(stream.schema).parquet(run_to_folder(stream, name))


def stream_event_features(events: DataFrame, seed=42) -> DataFrame:
    """The per-row event features of a stream; they need no state."""
    return row_features(resolve_events(events), seed)


def activity_columns() -> list[Column]:
    """Counts of the log features over rows with ``activity`` and ``ts``; as in the log tables, only logon records have hours."""
    kind = F.lower("activity")
    return [
        F.count_if(kind == "logon").alias("logon_count"),
        F.count_if(kind == "logoff").alias("logoff_count"),
        F.sum(F.when(kind.isin("logon", "logoff"), after_hours(F.hour("ts"))).otherwise(0)).alias("after_hours"),
        F.count_if(kind == "device").alias("device_events"),
        F.count_if(kind == "email").alias("email_events"),
        F.count_if(kind == "file").alias("file_events"),
    ]


def user_activity(events: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Log counts per user and window, tumbling or sliding."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.withWatermark("ts", delay).groupBy(window, "user_id").agg(*activity_columns())
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "user_id",
                "logon_count", "logoff_count", "after_hours", "device_events", "email_events", "file_events")
    )


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream: a user's events with pauses of at most ``gap``.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` set in the session, a busy user's rows are
    combined inside each input partition before the shuffle; this function changes no setting.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
    )


def batch_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """The same sessions of a batch, safe for busy users.

    Events of one user in one time slice of the length of the gap are closer than the gap, so
    each (user, slice) is one piece of a session: a plain aggregate with map-side combine. Only
    these pieces, one per slice at most, are ordered per user and joined where they touch.
    """
    gap = gap_minutes * 60 * 1_000_000
    at = F.unix_micros("ts")
    pieces = (
        events.select("user_id", at.alias("at"), F.floor(at / gap).alias("slice"))
        .groupBy("user_id", "slice")
        .agg(F.min("at").alias("a"), (F.max("at") + gap).alias("b"), F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("user_id").orderBy("slice")
    earlier = F.lag("b").over(order)
    starts = pieces.withColumn("new", flag(earlier.isNull() | (F.col("a") > earlier)))
    numbered = starts.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(
        F.timestamp_micros(F.min("a")).alias("session_start"), F.timestamp_micros(F.max("b")).alias("session_end"),
        F.sum("n").alias("n_events"),
    ).drop("session")


def deduplicate(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """One row per key: within the watermark on a stream, overall in a batch (combined before the shuffle)."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def late_events(arrivals: DataFrame, delay_seconds: int = 3600) -> DataFrame:
    """Events per arrival batch and how many of them come too late.

    Input: ts and ``batch``, the number of the micro-batch an event arrives in. An event is late
    when it is older than the largest time of the earlier batches minus the delay.
    """
    newest = arrivals.groupBy("batch").agg(F.max("ts").alias("newest"))
    marks = running_totals(newest, [], ["batch"], ["newest"], how="max", before=True).select(
        "batch", (F.col("cum_newest") - F.make_dt_interval(secs=F.lit(delay_seconds))).alias("mark")
    )
    joined = lookup_join(arrivals, marks, "batch")
    late = F.coalesce(F.col("ts") < F.col("mark"), F.lit(False))
    return joined.groupBy("batch").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(late).alias("n_late"))
