"""The version log: one of two writers wins, a crash leaves nothing to be seen, many tables change at once."""

import threading

import pytest
from pyspark.sql import functions as F

from loomspan.sources import versions
from loomspan.sources.versions import Conflict, VersionLog


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def log(spark, tmp_path):
    return VersionLog(spark, str(tmp_path / "log"))


def test_versions_are_whole_and_old_ones_stay(spark, log):
    assert log.latest() == 0 and log.read() == {}
    a, b = spark.range(3).toDF("x"), spark.range(2).toDF("y")
    assert log.commit({"a": a, "b": b}, 0) == 1
    assert log.commit({"a": a.where("x > 0")}, 1) == 2
    assert rows(log.read()["a"]) == [(1,), (2,)] and rows(log.read()["b"]) == [(0,), (1,)]
    assert rows(log.read(1)["a"]) == [(0,), (1,), (2,)]
    assert log.commit({"c": b}, 2, drop=("b",)) == 3 and sorted(log.read()) == ["a", "c"]
    with pytest.raises(ValueError):
        log.manifest(9)


def test_a_stale_writer_fails_and_leaves_nothing_to_be_seen(spark, log):
    a = spark.range(3).toDF("x")
    log.commit({"a": a}, 0)
    log.commit({"a": a.where("x = 1")}, 1)
    with pytest.raises(Conflict):
        log.commit({"a": a.where("x = 2")}, 1)
    assert rows(log.read()["a"]) == [(1,)]


def test_of_concurrent_writers_one_wins(spark, log):
    log.commit({"a": spark.range(1).toDF("x")}, 0)
    gate, made, lost = threading.Barrier(4), [], []

    class Slow(VersionLog):
        def _publish(self, version, text):
            gate.wait(60)  # all have written their tables and none has seen another's version
            return super()._publish(version, text)

    def write(i):
        try:
            Slow(spark, log.root).commit({"a": spark.range(1).select(F.lit(i).cast("long").alias("x"))}, 1)
            made.append(i)
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(10, 14)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(made) == 1 and len(lost) == 3 and log.latest() == 2
    assert rows(log.read()["a"]) == [(made[0],)]
    assert log.vacuum() == 4 and rows(log.read()["a"]) == [(made[0],)]


def test_a_crash_before_the_manifest_changes_nothing(spark, log, monkeypatch):
    a = spark.range(3).toDF("x")
    log.commit({"a": a}, 0)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(VersionLog, "_publish", crash)
        log.commit({"a": a.where("x > 1")}, 1)
    assert log.latest() == 1 and rows(log.read()["a"]) == [(0,), (1,), (2,)]
    assert log.commit({"a": a.where("x > 1")}, 1) == 2


def test_restore_replaces_tables_merges_settings_and_empties_the_trash(spark, log):
    settings = lambda *kv: spark.createDataFrame(kv, "key string, value string")
    log.commit({"yarns": spark.range(5).toDF("id"), "settings": settings(("a", "1"), ("b", "2")), "trash": spark.range(2).toDF("id")}, 0)
    assert versions.restore(log, {"yarns": spark.range(1).toDF("id"), "settings": settings(("b", "9"), ("c", "3"))}, 1) == 2
    now = log.read()
    assert rows(now["yarns"]) == [(0,)] and rows(now["settings"]) == [("a", "1"), ("b", "9"), ("c", "3")] and now["trash"].count() == 0


def test_sync_carries_all_linked_projects_over_in_one_version(spark, log):
    sha = lambda t: F.sha2(F.lit(t), 256)
    docs = spark.createDataFrame([("p", "one\ntwo"), ("q", "three"), ("r", "four")], "doc string, text string")
    seen = docs.select("doc", F.sha2("text", 256).alias("seen"))
    states = spark.createDataFrame([("p", 1, "one"), ("p", 2, "two"), ("q", 1, "three")], "doc string, project_id int, at string")
    log.commit({"documents": docs, "witnesses": seen, "states": states}, 0)

    def carry(touched, before, after):  # a project keeps its line if the new text still has it
        held = after.select("doc", F.explode(F.split("text", "\n")).alias("at")).distinct()
        return touched.join(held.withColumn("there", F.lit(True)), ["doc", "at"], "left").select("doc", "project_id", F.when(F.col("there"), F.col("at")).alias("at"))

    incoming = spark.createDataFrame([("p", "zero\ntwo", True), ("q", "lossy", False), ("r", "four", True), ("s", "new", True)], "doc string, text string, safe boolean")
    assert versions.sync_documents(log, 1, incoming, carry) == 2
    now = log.read()
    assert rows(now["documents"]) == [("p", "zero\ntwo"), ("q", "three"), ("r", "four"), ("s", "new")]
    assert sorted(rows(now["states"]), key=repr) == sorted([("p", 1, None), ("p", 2, "two"), ("q", 1, "three")], key=repr)
    want = spark.range(1).select(*(sha(t).alias(d) for d, t in (("p", "zero\ntwo"), ("q", "three"), ("r", "four"), ("s", "new")))).first().asDict()
    assert dict(rows(now["witnesses"])) == want
    assert versions.sync_documents(log, 2, incoming.where("doc <> 'q'"), carry) == 2
    with pytest.raises(Conflict):
        versions.sync_documents(log, 1, incoming, carry)
