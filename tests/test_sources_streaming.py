"""Readers, sinks and streaming forms."""

import json
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.sources import tables
from loomspan.streaming import sessions as streams


def test_snapshot_round_trip(spark, tmp_path):
    a = spark.range(5)
    base = tables.write_snapshot({"a": a, "b": a.where("id > 2")}, str(tmp_path), "v1")
    back = tables.read_snapshot(spark, base)
    assert sorted(back) == ["a", "b"] and back["b"].count() == 2


def test_bad_entries_are_reported_and_the_rest_is_read(spark, tmp_path):
    for i, body in enumerate((json.dumps({"id": 1, "name": "a"}), "{broken", json.dumps({"name": "no id"}), json.dumps({"id": 2, "name": "b"}))):
        folder = tmp_path / f"e{i}"
        folder.mkdir()
        (folder / "entry.json").write_text(body)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    good, bad = tables.read_entries(spark, str(tmp_path), schema, skip=spark.createDataFrame([(2,)], "id long"))
    assert [r["name"] for r in good.collect()] == ["a"]
    assert sorted(r["code"] for r in bad.collect()) == ["bad_id", "unreadable"]
    (tmp_path / "e9").mkdir()
    (tmp_path / "e9" / "entry.json").write_text(json.dumps({"id": 9, "name": "x" * 5000}))
    good, bad = tables.read_entries(spark, str(tmp_path), schema, most_bytes=4000)
    assert sorted(r["name"] for r in good.collect()) == ["a", "b"]
    assert sorted((r["file"].rsplit("/", 2)[-2], r["code"]) for r in bad.collect()) == [("e1", "unreadable"), ("e2", "bad_id"), ("e9", "too_large")]


def test_defaults_do_not_hide_the_filter(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "crochet")], "id long, technique string").write.parquet(str(tmp_path / "projects"))
    df = tables.seek(tables.read_table(spark, str(tmp_path), "projects"), "id", 1)
    assert df.first()["technique"] == "knitting"
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1)]" in df._jdf.queryExecution().toString()


def test_html_lines(spark):
    df = spark.createDataFrame([(1, "<html><style>x{}</style><p>A &amp; B</p><script>bad()</script><div>two<br>three</div>"), (2, None)], "page_id long, html string")
    assert [r["text"] for r in tables.read_html_lines(df).orderBy("line_no").collect()] == ["A & B", "two", "three"]


def _drain(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_session_stream(spark, tmp_path):
    t = lambda h, m=0: datetime(2026, 1, 1, h, m)
    schema = "project_id long, section_id long, id long, started timestamp, duration_sec long, manual boolean"
    parts = [[(1, 1, 1, t(8), 600, False), (1, 1, 2, t(9), 600, False), (1, 1, 9, t(9, 5), 600, True)], [(1, 1, 3, t(12), 60, False)], [(2, 1, 4, t(20), 5, False)], [(2, 1, 5, t(20, 30), 5, False)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _drain(streams.session_stream(chunks), "closed_sessions")
    got = sorted(tuple(r) for r in spark.table("closed_sessions").select("project_id", "duration_sec", "chunks").collect())
    assert (1, 1200, 2) in got and (2, 10, 2) not in got


def test_stream_and_batch_find_the_same_sessions(spark, tmp_path):
    """Long chunks that cover short ones, fractions of a second, a gap of exactly two hours, rows out of order."""
    from loomspan.operators import sessionize

    t = lambda h, m=0, s=0, us=0: datetime(2026, 1, 1 + h // 24, h % 24, m, s, us)
    schema = "project_id long, section_id long, id long, started timestamp, duration_sec long, manual boolean"
    rows = [(1, 1, 2, t(9), 600, False), (1, 1, 1, t(8), 6 * 3600, False), (1, 1, 3, t(14, 30), 60, False), (1, 1, 4, t(16, 31), 60, False), (2, 1, 5, t(1), 0, False), (2, 1, 6, t(3), 5, False), (3, 1, 7, t(1, 0, 0, 900_000), 0, False)]
    rows += [(3, 1, 8, t(3, 0, 0, 100_000), 5, False), (3, 1, 9, t(3, 0, 1), 5, True), (3, 2, 10, t(3), None, False), (9, 9, 11, t(40), 1, False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, 9, 12, t(60), 1, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    _drain(streams.session_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), "same_sessions")
    got = sorted(tuple(r) for r in spark.table("same_sessions").where("project_id < 9").select("project_id", "section_id", "started", "duration_sec", "chunks").collect())
    batch = sessionize.merge_sessions(spark.createDataFrame(rows, schema), "project_id", "section_id").where("project_id < 9")
    want = sorted((r["project_id"], r["section_id"], r["started"], r["duration_sec"] or 0, r["chunks"]) for r in batch.collect())
    assert got == want and (1, 1, t(8), 6 * 3600 + 660, 3) in got and len([r for r in got if r[0] == 2]) == 2 and (3, 1, t(1, 0, 0, 900_000), 5, 2) in got


def test_batches_are_committed_once(spark, tmp_path):
    path, mark, source = (str(tmp_path / x) for x in ("out", "mark", "in"))
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(source)
        streams.commit_batches(spark.readStream.schema("id long").parquet(source), path, mark, every=None).awaitTermination()
        assert sorted(r["id"] for r in streams.committed(spark, path).collect()) == list(range(part * 10 + 10))
    streams.commit_batches(spark.readStream.schema("id long").parquet(source), path, mark, every=None).awaitTermination()
    assert streams.committed(spark, path).count() == 20


def test_csv_files_have_mark_and_header(spark, tmp_path):
    from loomspan.operators.imports import write_csv

    df = spark.createDataFrame([(1, "=a"), (2, "b;c")], "id long, name string").coalesce(1)
    write_csv(df, ["id", "name"], str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode("utf-8")
    assert text == "\ufeffid;name\r\n1;'=a\r\n2;\"b;c\"\r\n"


def test_every_csv_file_has_one_mark_and_header_whatever_the_partitions(spark, tmp_path):
    from loomspan.operators.imports import write_csv

    df = spark.range(80).selectExpr("id", "concat('n', id) AS name").repartition(8)
    write_csv(df, ["id", "name"], str(tmp_path / "csv"))
    files = [f.read_bytes().decode("utf-8") for f in (tmp_path / "csv").glob("part-*")]
    assert len(files) == 8 and all(t.startswith("\ufeffid;name\r\n") and t.count("\ufeff") == t.count("id;name") == 1 and t.endswith("\r\n") for t in files)
    assert sorted(int(x.split(";")[0]) for t in files for x in t.split("\r\n")[1:-1]) == list(range(80))
    write_csv(df.where("id < 0"), ["id", "name"], str(tmp_path / "none"))
    assert all(not f.read_bytes() for f in (tmp_path / "none").glob("part-*"))


def test_sheet_columns_go_by_their_headers(spark):
    from loomspan.operators.imports import rename_sheet

    sheet = spark.createDataFrame([("Drops", "in stash", "x"), (" ", "", "")], "`Brand ` string, `STATUS` string, `Mood` string")
    (row,) = rename_sheet(sheet).collect()
    assert row["brand"] == "Drops" and row["status"] == "in stash" and row["notes"] is None


def test_day_journal_and_once_only(spark, tmp_path):
    spark.createDataFrame([(datetime(2026, 1, 1, h), "a" if h < 3 else "b") for h in range(5)], "started timestamp, tap_id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("started timestamp, tap_id string").parquet(str(tmp_path / "in"))
    _drain(streams.day_journal(stream()), "journal")
    assert spark.table("journal").count() == 1
    _drain(streams.once_only(stream().withColumnRenamed("started", "at")), "taps")
    assert spark.table("taps").count() == 2


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 91
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert F is not None
