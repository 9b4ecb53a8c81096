"""The timer and the debounce: literal cases, a batch replay, and streams across restarts that give the same rows."""

import random
from datetime import datetime, timedelta

import pytest

from loomspan.streaming import timer

T0 = datetime(2026, 3, 1, 9)
SCHEMA = "owner string, at timestamp, seq long, command string, project_id long, section_id long, since timestamp, line long"


def at(sec):
    return T0 + timedelta(seconds=sec)


def commands(*rows, owner="a"):
    return [(owner, at(sec), i, name, *(more + (None,) * 4)[:2], at(more[2]) if len(more) > 2 and more[2] is not None else None, more[3] if len(more) > 3 else None) for i, (sec, name, *more_) in enumerate(rows) for more in [tuple(more_)]]


def replayed(spark, rows):
    got = timer.replay_timer(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r["owner"], r["line"], r["project_id"], r["section_id"], (r["began"] - T0).total_seconds(), (r["written"] - T0).total_seconds(), r["added_sec"], r["duration_sec"]) for r in got)


H = 3600
CASES = {
    "a pause writes whole seconds and keeps the rest": ([(0, "open", 1, 7), (0, "play"), (10.6, "pause"), (20, "play"), (30.6, "pause")], [(1, 1, 7, 10.6, 10.6, 10, 10), (1, 1, 7, 10.6, 30.6, 11, 21)]),
    "under a second nothing is written": ([(0, "open", 1, 7), (0, "play"), (0.9, "pause"), (5, "pause")], []),
    "two hours since the last write split, a second less does not": (
        [(0, "open", 1, 7), (0, "play"), (60, "pause"), (60 + 2 * H - 1, "play"), (60 + 2 * H, "pause"), (60 + 4 * H, "play"), (70 + 4 * H, "pause")],
        [(1, 1, 7, 60, 60, 60, 60), (1, 1, 7, 60, 60 + 2 * H, 1, 61), (2, 1, 7, 70 + 4 * H, 70 + 4 * H, 10, 10)],
    ),
    "another slot ends the running one, which writes to its own": ([(0, "open", 1, 7), (0, "play"), (30, "open", 1, 8), (40, "play"), (50, "open", 2, 8), (60, "pause")], [(1, 1, 7, 30, 30, 30, 30), (1, 1, 8, 30, 50, 10, 40)]),
    "the same slot changes nothing": ([(0, "open", 1, 7), (0, "play"), (30, "open", 1, 7), (40, "pause")], [(1, 1, 7, 40, 40, 40, 40)]),
    "a stop writes and forgets": ([(0, "open", 1, 7), (0, "play"), (9, "stop"), (20, "pause")], [(1, 1, 7, 9, 9, 9, 9)]),
    "a start within a stop survives it": ([(0, "open", 1, 7), (0, "play"), (9, "pause"), (10, "play"), (11, "stop", None, None, 9), (12, "open", 2, 7), (15, "pause")], [(1, 1, 7, 9, 9, 9, 9)]),
    "without a project nothing is written": ([(0, "play"), (50, "pause")], []),
    "discarded time is not written": ([(0, "open", 1, 7), (0, "play"), (50, "discard"), (60, "pause"), (61, "open", 1, 7), (61, "play"), (65, "pause")], [(1, 1, 7, 65, 65, 4, 4)]),
    "a deleted line is begun anew": ([(0, "open", 1, 7), (0, "play"), (10, "pause"), (11, "play"), (12, "forget", None, None, None, 1), (20, "pause")], [(1, 1, 7, 10, 10, 10, 10), (2, 1, 7, 20, 20, 9, 9)]),
    "other projects have lines of their own": ([(0, "open", 1, 7), (0, "play"), (10, "open", 2, 7), (10, "play"), (20, "open", 1, 7), (20, "play"), (30, "stop")], [(1, 1, 7, 10, 10, 10, 10), (1, 1, 7, 10, 30, 10, 20), (2, 2, 7, 20, 20, 10, 10)]),
}


@pytest.mark.parametrize("name", CASES)
def test_timer_cases(spark, name):
    rows, want = CASES[name]
    assert [r[1:] for r in replayed(spark, commands(*rows))] == want


def test_repeated_delivery_is_harmless(spark):
    rows = commands(*CASES["other projects have lines of their own"][0])
    assert replayed(spark, rows + rows) == replayed(spark, rows)
    assert timer.replay_timer(spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA)).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def fed(spark, tmp_path, parts, schema, make):
    """Rows of a stream that reads ``parts`` one run after the other; each run starts from the checkpoint."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_timer_stream_equals_the_replay_across_restarts(spark, tmp_path, rocks):
    rng, rows = random.Random(4), []
    for owner in ("a", "b", "c"):
        clock, some = 0.0, []
        for _ in range(240):
            clock += rng.choice([0.3, 5, 100, 4000, 9000])
            name = rng.choice(["open", "open", "play", "play", "pause", "stop", "discard", "forget"])
            some.append((clock, name, rng.randint(1, 2), rng.randint(1, 2), clock - rng.choice([0.1, 200]) if name == "stop" else None, rng.randint(1, 9)))
        rows += commands(*some, owner=owner)
    rows.sort(key=lambda r: r[1])
    parts = [rows[:300], rows[200:500], rows[500:]]  # the second run delivers some again
    got = fed(spark, tmp_path, parts, SCHEMA, timer.timer_stream)
    want = [tuple(r) for r in timer.replay_timer(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    lines = timer.journal(spark.createDataFrame(want, "owner string, line long, project_id long, section_id long, began timestamp, written timestamp, added_sec long, duration_sec long, commands long")).collect()
    totals = {}
    for w in want:
        totals[w[0], w[1]] = totals.get((w[0], w[1]), 0) + w[6]
    assert {(r["owner"], r["line"]): r["duration_sec"] for r in lines} == totals


CHANGES = "key string, at timestamp, seq long, kind string, value string"


def test_debounce_patterns(spark):
    sparse = [("s", at(t), 0, None, str(t)) for t in (0, 20, 100)]
    dense = [("d", at(t), 0, None, str(t)) for t in (0, 3, 6, 9)]
    endless = [("e", at(t), 0, None, str(t)) for t in range(0, 70, 2)]
    edge = [("x", at(t), 0, None, str(t)) for t in (0, 8)]  # due just as the next change comes
    asked = [("f", at(0), 0, None, "0"), ("f", at(1), 0, "flush", None), ("f", at(2), 0, "flush", None), ("f", at(3), 0, None, "3"), ("f", at(4), 0, "cancel", None), ("f", at(5), 0, None, "5")]
    got = timer.debounced(spark.createDataFrame(sparse + dense + endless + edge + asked, CHANGES)).collect()
    rows = sorted((r["key"], (r["fired"] - T0).total_seconds(), (r["first"] - T0).total_seconds(), r["changes"], r["value"]) for r in got)
    assert rows == [
        ("d", 17, 0, 4, "9"), ("e", 30, 0, 15, "28"), ("e", 60, 30, 15, "58"), ("e", 76, 60, 5, "68"), ("f", 1, 0, 1, "0"), ("f", 13, 5, 1, "5"),
        ("s", 8, 0, 1, "0"), ("s", 28, 20, 1, "20"), ("s", 108, 100, 1, "100"), ("x", 8, 0, 1, "0"), ("x", 16, 8, 1, "8"),
    ]
    without = timer.debounced(spark.createDataFrame(endless, CHANGES), longest_ms=None).collect()
    assert [(r["fired"] - T0).total_seconds() for r in without] == [76]


def test_debounce_stream_fires_at_the_exact_times_across_restarts(spark, tmp_path, rocks):
    rng = random.Random(6)
    rows = sorted((rng.choice("abc"), at(rng.randint(0, 400) + rng.random()), 0, None, str(i)) for i in range(150))
    rows.sort(key=lambda r: r[1])
    rows = [(k, t.replace(microsecond=t.microsecond // 1000 * 1000), s, c, v) for k, t, s, c, v in rows]
    last = [("z", at(10_000), 0, None, "end")]  # takes the watermark past all others
    got = fed(spark, tmp_path, [rows[:50], rows[50:100], rows[100:], last, [("z", at(20_000), 0, None, "end")]], CHANGES, timer.debounce_stream)
    want = [tuple(r) for r in timer.debounced(spark.createDataFrame(rows, CHANGES)).collect()]
    assert sorted(r for r in got if r[0] != "z") == sorted(want) and len(want) > 10
