"""Windows and sessions of the activity log, as streams and as batches.

One definition serves both: ``event_windows`` and ``event_sessions`` take a DataFrame that is
read as a stream or as a batch. As a stream, events may come late by ``late``: a window or a
session is given out once the watermark, the latest time seen less ``late``, has passed its
end, and later rows of it are dropped; copies of an event are dropped as long as they aren't
later than that. So the state holds what is open, and what is given out is what a batch over
the same rows says about windows and sessions that have ended by then.

``merged_sessions`` is the batch form for large inputs: sessions are found within days of a
user, and those are merged, so that a user with many events is as many groups as days.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.functions.expr import count_rows, micros_between
from souk.session import ensure_checkpoint_dir

WIDTH, GAP, LATE = "6 hours", "2 hours", "1 hour"
MONEY = "decimal(18,2)"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _once(events: DataFrame, late: str) -> DataFrame:
    """Events with a time and without copies; the watermark bounds what must be remembered.
    Watermarks need instants: times without a zone are taken as UTC, whatever the session's."""
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col("ts")))
    rows = events.where("ts IS NOT NULL").withColumn("ts", instant).withWatermark("ts", late)
    return rows.dropDuplicates(["event_id", "ts"])


def _plain(instant: str) -> Column:
    """An instant as a time without a zone again."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(instant)), F.expr(EPOCH))


def event_windows(events: DataFrame, width: str = WIDTH, late: str = LATE, slide: str | None = None) -> DataFrame:
    """(window_start, window_end, event_type, events, value) of tumbling windows, or of
    sliding ones that start every ``slide``."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (_once(events, late).groupBy(span.alias("w"), "event_type")
            .agg(count_rows().alias("events"), F.sum(F.col("value").cast(MONEY)).alias("value"))
            .select(_plain("w.start").alias("window_start"), _plain("w.end").alias("window_end"), "event_type", "events",
                    F.col("value").cast("double").alias("value")))


def event_sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(user_id, session_start, session_end, events, value): runs of a user's events at most
    ``gap`` apart; a session ends ``gap`` after its last event."""
    # The bounds come from the events: a filter on the window's own bounds would be pushed
    # below the merging of sessions and change them.
    return (_once(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
            .agg(F.min("ts").alias("first"), (F.max("ts") + F.expr(f"INTERVAL {gap}")).alias("ended"), count_rows().alias("events"),
                 F.sum(F.col("value").cast(MONEY)).alias("value"))
            .select("user_id", _plain("first").alias("session_start"), _plain("ended").alias("session_end"), "events",
                    F.col("value").cast("double").alias("value")))


def merged_sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """The sessions of ``event_sessions`` over a batch, by merging those of each day."""
    until = lambda c: F.col(c) + F.expr(f"INTERVAL {gap}")
    rows = events.where("ts IS NOT NULL").dropDuplicates(["event_id", "ts"]).select(
        "user_id", F.to_date("ts").alias("day"), F.col("ts").alias("start"), F.col("ts").alias("last"),
        F.lit(1).cast("long").alias("n"), F.col("value").cast(MONEY).alias("value"))

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        before = Window.partitionBy(*by).orderBy("start", "last")
        # Runs don't overlap, so the one before ends last.
        opens = F.coalesce(F.col("start") > F.lag(until("last")).over(before), F.lit(True))
        numbered = df.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(before))
        return numbered.groupBy(*by, "session").agg(F.min("start").alias("start"), F.max("last").alias("last"),
                                                    F.sum("n").alias("n"), F.sum("value").alias("value")).drop("session")
    runs = merged(merged(rows, ["user_id", "day"]).drop("day"), ["user_id"])
    return runs.select("user_id", F.col("start").alias("session_start"), until("last").alias("session_end"),
                       F.col("n").alias("events"), F.col("value").cast("double").alias("value"))


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, since a stream's plain path must be a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(result: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and appends what is final to Parquet files in ``out``.
    Run again with the same ``checkpoint`` it goes on where it stopped, and each result is
    written once, whatever was lost in between."""
    stream = (result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start(out))
    stream.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(out)


def _new_place(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def stream_event_windows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The closed windows of the log at ``path``, by a stream."""
    return run_available(event_windows(read_stream(spark, path, schema)), *_new_place(spark, "windows"))


def stream_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ended sessions of the log at ``path``, by a stream."""
    return run_available(event_sessions(read_stream(spark, path, schema)), *_new_place(spark, "sessions"))


def session_summary(events: DataFrame) -> DataFrame:
    """For each user: sessions, their mean number of events, and the minutes of the longest."""
    minutes = micros_between("session_start", "session_end") / F.lit(60_000_000.0)
    return merged_sessions(events).groupBy("user_id").agg(
        count_rows().alias("sessions"), (F.sum("events") / count_rows()).alias("events_per_session"),
        F.max(minutes).alias("longest_minutes"))
