"""Merging timed work into sessions: a gap of two hours or more starts a new one (inventory J1-J6, E14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: seconds of the gap; a gap of exactly this length splits.
GAP_SEC = 7200


def merge_sessions(chunks: DataFrame, *keys: str) -> DataFrame:
    """One row a session of each key.

    ``chunks`` has the keys, ``id``, ``started``, ``duration_sec`` and ``manual``.  The gap is measured, to the microsecond, from the last
    contact: the latest end of all chunks before; rows entered by hand stand alone and are not returned.
    """
    timed = chunks.where(~F.coalesce("manual", F.lit(False)))
    order = Window.partitionBy(*keys).orderBy("started", "id")
    begins = F.unix_micros(F.col("started").cast("timestamp"))
    ended = begins + F.coalesce("duration_sec", F.lit(0)) * 1_000_000
    contact = F.max(ended).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((begins - contact >= GAP_SEC * 1_000_000).cast("int"), F.lit(1))
    return (
        timed.withColumn("new", new).withColumn("episode", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "episode")
        .agg(F.min_by("id", F.struct("started", "id")).alias("first_id"), F.min("started").alias("started"), F.sum("duration_sec").alias("duration_sec"), F.count(F.lit(1)).alias("chunks"))
    )


def chunk_to_commit(elapsed: Column, committed: Column) -> Column:
    """Whole seconds not yet written, null below one."""
    diff = F.floor(elapsed - committed)
    return F.when(diff >= 1, diff)
