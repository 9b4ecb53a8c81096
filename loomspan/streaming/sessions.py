"""Streaming sessions and journals (inventory J1-J7, J9-J17).

The batch forms live in ``loomspan.operators.sessionize``; these keep the same rules on unbounded input.  State lives in
Spark's own session windows and deduplication and goes with the watermark.  The timer command by command, the debounce and taps on the
current step have keyed state: ``timer`` and ``taps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators.sessionize import GAP_SEC


def session_gap() -> Column:
    """How long a chunk keeps its session open: its duration and two hours, less a microsecond, as a window takes in what
    starts at its very end and a gap of exactly two hours splits."""
    micros = F.coalesce("duration_sec", F.lit(0)).cast("long") * 1_000_000 + (GAP_SEC * 1_000_000 - 1)
    return F.concat(micros.cast("string"), F.lit(" microseconds"))


def session_stream(chunks: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Closed sessions of a stream of timed chunks (project_id, section_id, id, started, duration_sec, manual).

    A session closes when the watermark passes its last contact and the gap, so state is bounded by open sessions (J1, J2,
    J5, J7).  A section is a hard boundary (J6); rows entered by hand are not merged.
    """
    timed = chunks.where(~F.coalesce("manual", F.lit(False))).withColumn("started", F.col("started").cast("timestamp")).withWatermark("started", lateness)
    merged = timed.groupBy("project_id", "section_id", F.session_window("started", session_gap()).alias("w")).agg(
        F.min("started").alias("begun"), F.sum(F.coalesce("duration_sec", F.lit(0))).cast("long").alias("duration_sec"), F.count(F.lit(1)).alias("chunks")
    )
    ended = F.timestamp_micros(F.unix_micros("w.end") - (GAP_SEC * 1_000_000 - 1))
    return merged.select("project_id", "section_id", F.col("begun").alias("started"), ended.alias("ended"), "duration_sec", "chunks")


def commit_batches(rows: DataFrame, path: str, checkpoint: str, every: str | None = "8 seconds") -> StreamingQuery:
    """Write a stream to ``path`` batch by batch, one after the other.

    Each batch has a folder of its own that a retry overwrites whole, so rows are there once or not at all.  Batches start
    ``every`` so often, which gathers changes (J12, J13); without it, what is there is written and the query ends, as a job
    that must not be disturbed by further changes does (J14).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """What commit_batches has written."""
    return spark.read.parquet(path).drop("batch")


def day_journal(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Distinct active days of a stream; a day repeats only after its state has gone with the watermark."""
    days = events.select(F.date_trunc("day", F.col("started").cast("timestamp")).alias("day_start")).withWatermark("day_start", lateness)
    return days.dropDuplicatesWithinWatermark(["day_start"]).select(F.to_date("day_start").alias("day"))


def once_only(taps: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """At-least-once taps applied once: duplicates of ``tap_id`` within the watermark go."""
    return taps.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["tap_id"])


def activity_stream(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Seconds and sessions a day of a stream, final once the watermark has passed the day (D1 on streams)."""
    timed = events.withColumn("started", F.col("started").cast("timestamp")).withWatermark("started", lateness)
    per_day = timed.groupBy(F.window("started", "1 day")).agg(F.sum("duration_sec").alias("total_sec"), F.count(F.lit(1)).alias("sessions"))
    return per_day.select(F.to_date("window.start").alias("day"), "total_sec", "sessions")
