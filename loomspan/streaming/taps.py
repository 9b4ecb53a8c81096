"""Taps on a project's steps, applied once and only to the step the project is at (inventory J15-J17).

A project's steps have an order; it is at the first that is not done.  A tap for another step, or one delivered before, does
nothing.  A tap counts a counter up or down between 0 and its total, which makes it done, and marks any other step as done.
On a stream the place, the count and the taps seen are state; the batch form folds sorted rows with the same rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

APPLIED = "project_id long, tap_id string, step_id string, count int, done boolean"


def apply_tap(place: int, count: int, steps: list, step_id: str, delta: int) -> tuple[int, int, bool] | None:
    """(place, count of that step, done) after a tap, or None if it is not for the step at ``place``; ``steps`` are (step_id, total),
    total null for one that is no counter."""
    if place >= len(steps) or steps[place][0] != step_id:
        return None
    total = steps[place][1]
    if total is None:
        return place + 1, 1, True
    now = min(max(count + (-1 if delta == -1 else 1), 0), total)
    return (place + 1, now, True) if now >= total else (place, now, False)


class _TapProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "place int, count int")
        self.seen = handle.getMapState("seen", "tap_id string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place, count = self.place.get() if self.place.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: (r.at, r.tap_id)):
            if self.seen.containsKey((r.tap_id,)):
                continue
            self.seen.updateValue((r.tap_id,), (r.at,))
            after = apply_tap(place, count, [(s["step_id"], s["total"]) for s in r.steps], r.step_id, r.delta)
            if after:
                yield Row(project_id=key[0], tap_id=r.tap_id, step_id=r.step_id, count=after[1], done=after[2])
                count = 0 if after[2] else after[1]
                place = after[0]
        self.place.update((place, count))


def _with_steps(taps: DataFrame, steps: DataFrame) -> DataFrame:
    """Taps with the ordered steps of their project; taps of unknown projects go."""
    plan = steps.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "step_id", "total"))), lambda s: F.struct(s["step_id"].alias("step_id"), s["total"].cast("int").alias("total"))).alias("steps"))
    rows = taps.where("tap_id IS NOT NULL AND project_id IS NOT NULL").select("project_id", "tap_id", "step_id", F.coalesce("delta", F.lit(1)).cast("int").alias("delta"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    return rows.join(plan, "project_id")


def tap_stream(taps: DataFrame, steps: DataFrame) -> DataFrame:
    """Applied taps of a stream (project_id, tap_id, step_id, delta, at); ``steps`` (project_id, position, step_id, total) is a table."""
    return _with_steps(taps, steps).groupBy("project_id").transformWithState(_TapProcessor(), StructType.fromDDL(APPLIED), "append", "none")


def replay_taps(taps: DataFrame, steps: DataFrame) -> DataFrame:
    """The same from a whole table of taps."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, place, count = None, 0, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["project_id"] != project:
                    project, place, count = r["project_id"], 0, 0
                after = apply_tap(place, count, [(s["step_id"], s["total"]) for s in r["steps"]], r["step_id"], r["delta"])
                if after:
                    out.append((project, r["tap_id"], r["step_id"], after[1], after[2]))
                    place, count = after[0], 0 if after[2] else after[1]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in APPLIED.split(", ")])

    first = taps.groupBy("project_id", "tap_id").agg(F.min(F.struct("at", "step_id", "delta")).alias("t")).select("project_id", "tap_id", "t.*")
    return _with_steps(first, steps).repartition("project_id").sortWithinPartitions("project_id", "at", "tap_id").mapInArrow(fold, APPLIED)
