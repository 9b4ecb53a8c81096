"""The work timer and the debounce as keyed state, with a batch replay that gives the same rows (inventory J1-J8, J12-J14).

Commands of one owner's timer are folded in the order of ``at`` and ``seq``: on a stream with one value state and one map
state an owner, in a batch over sorted rows, one owner after the other, with only the open timer in memory.  Both run the
same fold, so a stream gives, also across restarts, the rows of a replay of all it has read.

``open`` takes the timer to a slot, a project and a section: from another slot, what ran is written first.  ``play`` starts it;
less than two hours after the project's last line was written it goes on in that line, else a new episode begins.
``pause`` stops it and writes the whole seconds not yet written, if there is one; ``stop`` does that and forgets the slot,
but a start given after ``since``, when the stop was begun, survives; ``discard`` forgets without writing; ``forget``
says that a line was deleted elsewhere.  Each write is a row; rows of one line carry its seconds so far, so a sink that
keeps the newest row of a line may see a row twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loomspan.operators.sessionize import GAP_SEC

_MICRO = 1_000_000
#: One write: line, project and section, when the line began and was last written (microseconds), seconds written now and in all.
WRITES = "owner string, line long, project_id long, section_id long, began long, written long, added_sec long, duration_sec long, commands long"
_STATE = "project long, section long, spent double, committed long, target long, running long, next long, at long, seq long, applied long"
_LINES = "line long, began long, written long, duration_sec long"


@dataclass
class Timer:
    """One owner's timer.  ``lines`` is the last line of every project: number, begun, written, seconds."""

    project: int | None = None
    section: int | None = None
    spent: float = 0.0
    committed: int = 0
    target: int | None = None
    running: int | None = None
    next: int = 1
    at: int | None = None
    seq: int | None = None
    applied: int = 0
    lines: dict = field(default_factory=dict)

    def apply(self, command: str, at: int, seq: int, project: int | None = None, section: int | None = None, since: int | None = None, line: int | None = None) -> Iterator[tuple]:
        """What a command writes: (line, project, section, began, written, added, total).  A command no later than one applied
        before is a repetition and does nothing."""
        if self.at is not None and (at, seq) <= (self.at, self.seq):
            return
        self.at, self.seq, self.applied = at, seq, self.applied + 1
        if command == "open" and (project, section) != (self.project, self.section):
            self._halt(at)
            yield from self._write(at)
            self._empty(project, section)
        elif command == "play" and self.running is None:
            self.running = at
            if self.project is not None:
                last = self.lines.get(self.project)
                if last and at - last[2] < GAP_SEC * _MICRO:
                    self.target = last[0]
                else:  # a new episode; what is left of the old one goes to its own line
                    yield from self._write(at)
                    self.spent, self.committed, self.target = 0.0, 0, None
        elif command == "pause":
            self._halt(at)
            yield from self._write(at)
        elif command == "stop":
            restarted = self.running is not None and since is not None and self.running > since
            kept = self.running if restarted else None
            if not restarted:
                self._halt(at)
                yield from self._write(at)
            self._empty(None, None)
            self.running = kept
        elif command == "discard":
            self._empty(None, None)
        elif command == "forget":
            if self.project is not None and self.target == line:
                self.target = None
            for p, last in list(self.lines.items()):
                if last[0] == line:
                    del self.lines[p]

    def _halt(self, at: int) -> None:
        if self.running is not None:
            self.spent += (at - self.running) / _MICRO
            self.running = None

    def _empty(self, project: int | None, section: int | None) -> None:
        self.project, self.section, self.spent, self.committed, self.target, self.running = project, section, 0.0, 0, None, None

    def _write(self, at: int) -> Iterator[tuple]:
        added = math.floor(self.spent - self.committed)
        if self.project is None or added < 1:
            return
        last = self.lines.get(self.project)
        if last and last[0] == self.target:
            row = (last[0], last[1], at, last[3] + added)
        else:  # no line to go on with, or it is gone
            row, self.next = (self.next, at, at, added), self.next + 1
        self.lines[self.project], self.target = row, row[0]
        self.committed += added
        yield row[0], self.project, self.section, row[1], at, added, row[3]


_FIELDS = ("project", "section", "spent", "committed", "target", "running", "next", "at", "seq", "applied")


class _Lines:
    """The map state as far as the timer needs it."""

    def __init__(self, state):
        self.state = state

    def get(self, project):
        return tuple(self.state.getValue((project,))) if self.state.containsKey((project,)) else None

    def items(self):
        return [(k[0], tuple(v)) for k, v in self.state.iterator()]

    def __setitem__(self, project, row):
        self.state.updateValue((project,), row)

    def __delitem__(self, project):
        self.state.removeKey((project,))


def _commands(rows: Iterable) -> list:
    return sorted(rows, key=lambda r: (r.at, r.seq))


class _TimerProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("slot", _STATE)
        self.lines = handle.getMapState("lines", "project long", _LINES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer = Timer(**dict(zip(_FIELDS, self.slot.get()))) if self.slot.exists() else Timer()
        timer.lines = _Lines(self.lines)
        for r in _commands(rows):
            for w in timer.apply(r.command, r.at, r.seq, r.project_id, r.section_id, r.since, r.line):
                yield Row(owner=key[0], line=w[0], project_id=w[1], section_id=w[2], began=w[3], written=w[4], added_sec=w[5], duration_sec=w[6], commands=timer.applied)
        self.slot.update(tuple(getattr(timer, f) for f in _FIELDS))


def _normal(commands: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c in commands.columns else F.lit(None).cast("long")
    known = lambda c: (F.col(c) if c in commands.columns else F.lit(None)).cast("long").alias(c)
    return commands.where("owner IS NOT NULL AND at IS NOT NULL").select(
        F.col("owner").cast("string").alias("owner"), micros("at").alias("at"), F.coalesce(known("seq"), F.lit(0)).alias("seq"), "command", known("project_id"), known("section_id"), micros("since").alias("since"), known("line")
    )


def _timed(writes: DataFrame) -> DataFrame:
    return writes.withColumn("began", F.timestamp_micros("began")).withColumn("written", F.timestamp_micros("written"))


def timer_stream(commands: DataFrame) -> DataFrame:
    """Writes of a stream of commands (owner, at, seq, command, project_id, section_id; since and line where given).

    Commands of an owner are sorted within a batch; one that is no later than the last applied is dropped, which makes a
    repeated delivery harmless.  The state store must be the one with several states a key (RocksDB).
    """
    writes = _normal(commands).groupBy("owner").transformWithState(_TimerProcessor(), StructType.fromDDL(WRITES), "append", "none")
    return _timed(writes)


def replay_timer(commands: DataFrame) -> DataFrame:
    """The same writes from a whole table: owners are dealt out, sorted, and folded one after the other."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, timer = None, Timer()
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["owner"] != owner:
                    owner, timer = r["owner"], Timer()
                for w in timer.apply(r["command"], r["at"], r["seq"], r["project_id"], r["section_id"], r["since"], r["line"]):
                    out.append((owner, *w, timer.applied))
            columns = zip(*out) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=[f.split()[0] for f in WRITES.split(", ")])

    return _timed(_normal(commands).repartition("owner").sortWithinPartitions("owner", "at", "seq").mapInArrow(fold, WRITES))


def journal(writes: DataFrame) -> DataFrame:
    """The newest state of every line: owner, line, project_id, section_id (of its first write), began, written, duration_sec."""
    newest = F.struct("commands", "written")
    return writes.groupBy("owner", "line").agg(
        F.first("project_id").alias("project_id"), F.min_by("section_id", newest).alias("section_id"), F.min("began").alias("began"), F.max("written").alias("written"), F.max_by("duration_sec", newest).alias("duration_sec")
    )


# Quiet period and longest wait of a backup, in milliseconds.
QUIET_MS, LONGEST_MS = 8_000, 30_000


@dataclass
class Burst:
    """Changes not yet acted on: the first, the last, how many, and the newest value."""

    first: int | None = None
    last: int = 0
    changes: int = 0
    value: str | None = None

    def due(self, quiet: int, longest: int | None) -> int | None:
        if self.first is None:
            return None
        return self.last + quiet if longest is None else min(self.last + quiet, self.first + longest)

    def until(self, now: int, quiet: int, longest: int | None) -> Iterator[tuple[int, int, int, str | None]]:
        """(fired, first, changes, value) if the burst is due by ``now``."""
        due = self.due(quiet, longest)
        if due is not None and due <= now:
            yield due, self.first, self.changes, self.value
            self.first, self.changes, self.value = None, 0, None

    def add(self, at: int, kind: str | None, value: str | None, quiet: int, longest: int | None) -> Iterator[tuple[int, int, int, str | None]]:
        """``kind`` cancel forgets the burst, flush acts at once, all else is a change."""
        yield from self.until(at, quiet, longest)
        if kind == "cancel":
            self.first, self.changes, self.value = None, 0, None
        elif kind == "flush":
            if self.first is not None:
                yield at, self.first, self.changes, self.value
            self.first, self.changes, self.value = None, 0, None
        else:
            self.first, self.last, self.changes, self.value = at if self.first is None else self.first, at, self.changes + 1, value


FIRES = "key string, fired long, first long, changes long, value string"
_BURST = "first long, last long, changes long, value string"


class _DebounceProcessor(StatefulProcessor):
    def __init__(self, quiet: int, longest: int | None):
        self.quiet, self.longest = quiet, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("burst", _BURST)

    def _rows(self, key, fires) -> Iterator[Row]:
        for fired, first, changes, value in fires:
            yield Row(key=key[0], fired=fired, first=first, changes=changes, value=value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        burst = Burst(*self.state.get()) if self.state.exists() else Burst()
        armed = burst.due(self.quiet, self.longest)
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            yield from self._rows(key, burst.add(r.at, r.kind, r.value, self.quiet, self.longest))
        due = burst.due(self.quiet, self.longest)
        if armed is not None and armed != due:
            self.handle.deleteTimer(armed)
        if due is not None and armed != due:
            self.handle.registerTimer(due)
        if due is None:
            self.state.clear()
        else:
            self.state.update((burst.first, burst.last, burst.changes, burst.value))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            burst = Burst(*self.state.get())
            yield from self._rows(key, burst.until(expiredTimerInfo.getExpiryTimeInMs(), self.quiet, self.longest))
            if burst.first is None:
                self.state.clear()


def _changes(changes: DataFrame, key: str) -> DataFrame:
    text = lambda c: (F.col(c) if c in changes.columns else F.lit(None)).cast("string").alias(c)
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(0)) if "seq" in changes.columns else F.lit(0).cast("long")
    return changes.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(F.col(key).cast("string").alias("key"), F.col("at").cast("timestamp").alias("time"), F.unix_millis(F.col("at").cast("timestamp")).alias("at"), seq.alias("seq"), text("kind"), text("value"))


def _fired(fires: DataFrame) -> DataFrame:
    return fires.withColumn("fired", F.timestamp_millis("fired")).withColumn("first", F.timestamp_millis("first"))


def debounce_stream(changes: DataFrame, key: str = "key", quiet_ms: int = QUIET_MS, longest_ms: int | None = LONGEST_MS, lateness: str = "0 seconds") -> DataFrame:
    """One row for each burst of changes of a key, at the exact time it is due: ``quiet_ms`` after its last change, but no later
    than ``longest_ms`` after its first (J12, J13).  A later change, or the watermark passing the due time, brings the row out."""
    timed = _changes(changes, key).withWatermark("time", lateness)
    fires = timed.groupBy("key").transformWithState(_DebounceProcessor(quiet_ms, longest_ms), StructType.fromDDL(FIRES), "append", "eventTime")
    return _fired(fires)


def debounced(changes: DataFrame, key: str = "key", quiet_ms: int = QUIET_MS, longest_ms: int | None = LONGEST_MS) -> DataFrame:
    """The same rows from a whole table; bursts still open at its end are due as well."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIRES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        current, burst = None, Burst()

        def end() -> list[tuple]:
            return [(current, *x) for x in burst.until(1 << 62, quiet_ms, longest_ms)]

        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["key"] != current:
                    out += end()
                    current, burst = r["key"], Burst()
                out += [(current, *x) for x in burst.add(r["at"], r["kind"], r["value"], quiet_ms, longest_ms)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)
        rest = end()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rest], t) for i, t in enumerate(kinds)], names=names)

    rows = _changes(changes, key).drop("time").repartition("key").sortWithinPartitions("key", "at", "seq")
    return _fired(rows.mapInArrow(fold, FIRES))
