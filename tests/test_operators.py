"""Operators on small hand-written relations, expectations literal."""

import collections
import itertools
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loomspan.operators import activity, documents, imports, layout, ledger, mutations, progress, sessionize, stock, tools
from loomspan.plans import inventory, standins

REF = date(2026, 7, 15)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture
def sessions(spark):
    at = lambda d, h=12: datetime(2026, 7, d, h)
    data = [(1, 10, at(13), 1800, False), (2, 10, at(14), 3600, False), (3, 11, at(14, 13), 60, True), (4, None, at(6), 7200, False), (5, 10, None, 5, False), (6, 10, datetime(9999, 1, 1), 5, False)]
    return spark.createDataFrame(data, "id long, project_id long, started timestamp, duration_sec long, manual boolean")


def test_levels(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 1799, 1800, 3599, 3600, 7199, 7200)], "s long").select("s", activity.level(F.col("s")).alias("l"))
    assert [r["l"] for r in df.orderBy("s").collect()] == [0, 1, 1, 2, 2, 3, 3, 4]


def test_calendar(sessions):
    grid = {r["day"]: r for r in activity.activity_calendar(sessions, REF, "month").collect()}
    assert len(grid) == 35 and min(grid) == date(2026, 6, 15) and max(grid) == date(2026, 7, 19)
    assert (grid[date(2026, 7, 14)]["total_sec"], grid[date(2026, 7, 14)]["level"]) == (3660, 3)
    assert grid[date(2026, 7, 16)]["future"] and not grid[REF]["future"]


def test_streaks_and_ties(spark, sessions):
    daily = activity.by_day(sessions, 2027)
    assert activity.current_streak(daily, REF).first()["streak"] == 2
    assert activity.current_streak(daily, date(2026, 7, 17)).first()["streak"] == 0
    assert activity.longest_streak(daily).first()["streak"] == 2
    assert activity.best_day(daily).first()["day"] == date(2026, 7, 6)
    assert activity.best_weekday(daily).first()["weekday"] == 0
    empty = daily.where("false")
    assert activity.best_day(empty).first()["day"] is None and activity.best_weekday(empty).first()["weekday"] is None
    assert activity.active_share(empty, activity.day_set(empty), REF, REF).first()["average_sec"] is None


def test_technique_and_orphans(spark, sessions):
    projects = spark.createDataFrame([(10, "a", None), (12, "b", "crochet")], "id long, name string, technique string")
    assert rows(activity.filter_technique(sessions, projects, "knitting"), "id") == [(1,), (2,), (5,), (6,)]
    assert activity.filter_technique(sessions, projects, "all").count() == 6
    assert activity.both_techniques(projects).first()["shown"]
    named = activity.recent_sessions(sessions, projects, 2)
    assert [r["id"] for r in named.collect()] == [6, 3]
    detail = activity.day_detail(activity.by_day(sessions, 2027, "project_id"), projects)
    assert rows(detail.where("orphan"), "project_id") == [(11,), (None,)]


def test_gap_of_exactly_two_hours_splits(spark):
    t = lambda h, m=0, s=0: datetime(2026, 1, 1, h, m, s)
    data = [(1, 1, t(8), 3600, False), (2, 1, t(11), 60, False), (3, 1, t(13, 0, 59), 1, False), (4, 1, t(14), 9, True), (5, 2, t(9), 1, None)]
    df = spark.createDataFrame(data, "id long, project_id long, started timestamp, duration_sec long, manual boolean")
    assert rows(sessionize.merge_sessions(df, "project_id"), "project_id", "first_id", "duration_sec", "chunks") == [(1, 1, 3600, 1), (1, 2, 61, 2), (2, 5, 1, 1)]


LINE = "id string, yarn_id long, kind string, quantity string, unit_price string, currency string, date string, category string, label string, lot string"


@pytest.fixture
def lines(spark):
    data = [
        ("1", 1, "buy", "4", "5,50", "EUR", "2026-01-05", None, "a", "L1"), ("2", 1, "buy", "2", "12", "EUR", "2026-02-01", None, "b", " "), ("3", 2, "gift", "3", "9", "EUR", "2026-01-07", None, "c", "L2"),
        ("4", 2, "buy", "2", "", "EUR", "", None, "d", "L1"), ("5", 3, "buy", "1", "30", "CHF", " ", "tool", "e", None), ("6", 3, "buy", "1", "18,90 €", "CHF", "2025-12-31", "pattern", "f", None),
    ]
    return spark.createDataFrame(data, LINE)


def test_ledger(spark, lines):
    assert rows(ledger.by_currency(lines), "currency", "amount") == [("CHF", 30.0), ("EUR", 46.0)]
    assert rows(lines.where(ledger.price_unknown()), "id") == [("4",), ("6",)]
    assert rows(ledger.by_category(lines), "category", "currency", "amount") == [("pattern", None, None), ("tool", "CHF", 30.0), ("yarn", "EUR", 46.0)]
    assert rows(ledger.filter_year(lines, "unknown"), "id") == [("4",), ("5",)]
    months = rows(ledger.rollup(lines).where("currency = 'EUR'"), "year", "month", "amount", "lines")
    assert months == [("", "", 0.0, 1), ("", None, 0.0, 1), ("2026", "2026-01", 22.0, 2), ("2026", "2026-02", 24.0, 1), ("2026", None, 46.0, 3)]
    assert [r["id"] for r in ledger.newest_first(lines).collect()] == ["2", "3", "1", "6", "5", "4"]
    assert rows(ledger.yarn_totals(lines), "yarn_id", "skeins", "lots") == [(1, 6.0, "L1"), (2, 5.0, "L2 · L1"), (3, 2.0, "")]


def test_zero_priced_stock_makes_a_group(spark):
    df = spark.createDataFrame([("0", 2.0, ""), ("", 5.0, "CHF")], "price string, quantity double, currency string")
    assert rows(ledger.stock_value(df, "EUR"), "currency", "amount") == [("EUR", 0.0)]
    filled = ledger.fill_currency(df, "USD")
    assert rows(filled, "currency") == rows(ledger.fill_currency(filled, "GBP"), "currency") == [("CHF",), ("USD",)]


YARN = "id long, quantity double, reservations map<bigint,double>, consumed map<bigint,double>, price string, currency string, labels array<string>"


@pytest.fixture
def yarns(spark):
    data = [(1, 10.0, {1: 0.1, 2: 0.2}, None, "2", "EUR", ["vegan"]), (2, 0.0, None, {1: 3.0}, "", "", None), (3, 1.0, {9: 5.0}, {}, "x", "", ["vegan"]), (4, 5.0, {1: 0.0}, {2: 1.0}, None, "", [])]
    return spark.createDataFrame(data, YARN)


def test_stock(spark, yarns):
    assert rows(stock.with_availability(yarns), "id", "reserved", "available") == [(1, 0.3, 9.7), (2, 0.0, 0.0), (3, 5.0, 0.0), (4, 0.0, 5.0)]
    projects = spark.createDataFrame([(1, "done"), (2, "wip")], "id long, status string")
    assert rows(stock.usage_state(yarns, projects), "id", "state") == [(1, "reserved"), (2, "used"), (3, "reserved"), (4, "free")]
    both = spark.createDataFrame([(1, "done"), (2, "done"), (9, "done")], "id long, status string")
    assert rows(stock.usage_state(yarns, both), "id", "state") == [(1, "usedPartial"), (2, "used"), (3, "used"), (4, "free")]
    assert rows(stock.consume(yarns, F.lit(7).cast("long"), F.lit(1.0)), "id", "quantity")[0] == (1, 10.0)
    more = stock.reserve(yarns, F.lit(7).cast("long"), F.lit(100.0))
    assert rows(more, "id", "reservations") == [(1, {1: 0.1, 2: 0.2, 7: 9.7}), (2, {}), (3, {9: 5.0}), (4, {7: 5.0})]
    used = stock.consume(yarns, F.lit(1).cast("long"), F.lit(0.1))
    assert rows(used, "id", "quantity", "consumed")[0] == (1, 9.9, {1: 0.1})
    fixed = stock.correct_consumption(used, F.lit(1).cast("long"), F.lit(0.1))
    assert rows(fixed, "id", "quantity", "consumed")[:2] == [(1, 9.9, {1: 0.1}), (2, 2.9, {1: 0.1})]
    again = stock.correct_consumption(fixed, F.lit(1).cast("long"), F.lit(0.1))
    assert rows(again, "id", "quantity", "consumed") == rows(fixed, "id", "quantity", "consumed")
    assert rows(stock.projects_all_labelled(yarns, "vegan"), "project_id") == [(9,)]
    assert rows(stock.project_cost(yarns, "EUR").where("project_id = 1"), "currency", "amount", "priced", "unpriced") == [("EUR", 0.2, 1, 1)]


def test_tools(spark):
    kit = spark.createDataFrame([(1, "kit", None, [4.0, 3.5, 4.0]), (2, "needle", 4.5, None), (3, "hook", None, None)], "id long, category string, size_mm double, kit_sizes array<double>")
    assert rows(tools.group_by_size(kit), "tool_id", "size_mm") == [(1, 3.5), (1, 4.0), (2, 4.5), (3, None)]
    want = spark.createDataFrame([(4.0,), (4.001,), (5.0,), (None,)], "size_mm double")
    assert rows(tools.missing_sizes(want, kit), "size") == [(500,)]
    projects = spark.createDataFrame([(1, "wip", [2, 9, 2]), (2, "wip", [2]), (3, "done", [1])], "id long, status string, tool_ids array<bigint>")
    named = kit.withColumn("name", F.lit("n")).withColumn("quantity", F.lit(2))
    assert rows(tools.linked_tools(projects, named), "project_id", "tool_id", "place") == [(1, 2, 0), (2, 2, 0), (3, 1, 0)]
    assert rows(tools.free_tools(named, projects), "id", "free") == [(1, 2), (3, 2)]


def test_import(spark):
    sheet = spark.createDataFrame([("In Stash", "Écru", "Cascade", "220", "4", "10,0"), ("used up", "x", "Cascade", "221", "", ""), ("IN STASH ", "ecru", "CASCADE", "220", "1", "3"), ("", " ", "", "", "", "")], "Status string, `Colorway` string, BRAND string, Yarn string, Skeins string, `Price_Paid` string")
    found = imports.map_rows(imports.rename_sheet(sheet.coalesce(1))).withColumn("pos", F.monotonically_increasing_id())
    assert found.count() == 3
    assert rows(found, "brand", "unit_price") == [("CASCADE", 3.0), ("Cascade", 2.5), ("Cascade", None)]
    stored = spark.createDataFrame([("cascade", "221", "x")], "brand string, model string, color string")
    assert rows(imports.classify(found, stored), "model", "class") == [("220", "new"), ("220", "present"), ("221", "status")]


def test_mutations(spark):
    kids = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, project_id long")
    kept, bundle = mutations.split_cascade({"k": kids}, spark.createDataFrame([(2,)], "project_id long"))
    assert rows(kept["k"], "id") == [(1,), (3,)] and rows(bundle["k"], "id") == [(2,)]
    assert rows(mutations.restore_cascade(kept, bundle)["k"], "id") == rows(kids, "id")
    live, trash = mutations.to_trash(kids, spark.createDataFrame([(1,)], "id long"), "kid", F.lit("2026-01-01"))
    assert rows(mutations.from_trash(trash, live, "kid"), "id", "project_id") == rows(kids, "id", "project_id")
    cur = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    snap = spark.createDataFrame([("b", "9"), ("secret", "x")], "key string, value string")
    assert rows(mutations.merge_settings(snap, cur, ["secret"]), "key", "value") == [("a", "1"), ("b", "9")]
    good, bad = mutations.valid_rows(spark.createDataFrame([("1",), ("1.5",), ("x",), (None,)], "id string"))
    assert good.count() == 1 and rows(bad, "code") == [("bad_id",)] * 3


def test_state_is_carried_only_when_unique_on_both_sides(spark):
    step = "doc long, section int, pos int, text string"
    old = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "b"), (1, 0, 3, "c")], step)
    new = spark.createDataFrame([(1, 0, 0, "c"), (1, 0, 1, "a"), (1, 0, 2, "b")], step)
    got = mutations.reconcile_steps(old, new, old.select("doc", "section", "pos"))
    assert rows(got, "pos", "new_pos") == [(0, 1), (1, None), (2, None), (3, 0)]
    assert rows(mutations.reconcile_report(got), "kept", "lost", "show") == [(2, 2, "modal")]


def test_progress(spark):
    s = spark.createDataFrame([(1, 10, 20, False), (1, 5, 1, True), (1, 0, 4, False), (1, None, 3, False)], "project_id long, rows_total long, rows_done long, marked_done boolean")
    assert rows(progress.section_progress(s), "done", "total") == [(15, 15)]
    steps = spark.createDataFrame([(1, 0, 0, False, False, None, None, True), (1, 0, 1, False, True, 2, 3, False), (1, 0, 2, True, False, None, None, False)], "doc long, section int, pos int, note boolean, is_repeat boolean, counter int, repeat_total int, marked boolean")
    assert rows(progress.reader_progress(steps), "done", "total") == [(1, 2)]
    last = spark.createDataFrame([(1, 0)], "doc long, pos int")
    assert rows(progress.current_step(steps, last), "pos") == [(1,)]


def test_short_documents_are_told_as_any(spark):
    rng = random.Random(11)
    cells = [(rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 2, 3, None]), n, rng.choice(["Head 1", "head  2", "x" * 4001, "foot", "text", "row"])) for n in range(40) for _ in range(6)]
    lines = spark.createDataFrame([(d, p, n // 8, t) for d, p, n, t in cells], "doc string, page int, line_no int, text string")
    for one_in in (1, 2, 3):
        got = collections.Counter(documents.strip_short(lines, one_in).collect())
        assert got == collections.Counter(documents.strip_boilerplate(lines, one_in).collect()) and 0 < got.total() < len(cells)


def test_lines_of_orders_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks grow in number with the table and not in size, and rows are shuffled once."""
    monkeypatch.setattr(standins, "TASK_ROWS", 500, raising=False)
    df = inventory.stripped_lines(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert df.rdd.getNumPartitions() == 12


def test_documents(spark):
    page = lambda n: f"HEAD {n}\nrow {n}\nbody {n} unique words here\nrow x\nfoot"
    docs = spark.createDataFrame([("d", i, page(i) if i < 3 else "alone") for i in range(4)], "doc string, page int, text string")
    lines = documents.lines_of(docs, "doc", "page", "text")
    left = rows(documents.strip_boilerplate(lines), "page", "text")
    assert (0, "HEAD 0") not in left and (1, "foot") not in left and (1, "row x") in left and (3, "alone") in left
    texts = spark.createDataFrame([(1, "das ist ein Text und der Text ist nicht für die Katz " * 3), (2, "the cat sat on the mat " * 5), (3, "der die das")], "id int, t string")
    assert rows(texts.select("id", documents.is_german(F.col("t")).alias("g")), "id", "g") == [(1, True), (2, False), (3, False)]
    assert documents.common_lines(list("abcde"), list("axcye")) == 3
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(zip(row, row[1:], b), lambda left, c: max(left, c[1], c[0] + (c[2] == x)), initial=0)][1:]
        assert documents.common_lines(a, b) == row[-1]
    pair = spark.createDataFrame([("a\n b\nc", "a\nc\nd"), (None, "")], "a string, b string")
    assert rows(documents.similarity(pair), "ratio", "missing", "extra") == [(0.66667, 1, 1), (1.0, 0, 0)]
    med = spark.sql("SELECT array(3.0D, 1.0D, 2.0D, 9.0D) AS x, array() AS y").select(documents.upper_median(F.col("x")).alias("m"))
    assert med.first()["m"] == 3.0
    ev = spark.createDataFrame([("d", 0, 5.0, 1), ("d", 1, 2.0, 2)], "doc string, page int, y double, section long")
    pts = spark.createDataFrame([("d", 0, 1.0, 7), ("d", 0, 5.0, 8), ("d", 1, 9.0, 9)], "doc string, page int, y double, id long")
    assert rows(documents.active_section(ev, pts), "id", "section") == [(7, None), (8, 1), (9, 2)]
    conf = spark.createDataFrame([(4, 4, 10, 10, 0, 0, 0), (4, 0, 10, 0, 2, 0, 20)], "sections_total int, sections_known int, total_lines int, structured_lines int, vectors_seen int, vectors_ok int, warnings int")
    assert rows(documents.confidence(conf), "confidence", "level") == [(0, "low"), (100, "high")]


def test_gallery_orders_images_at_one_place(spark):
    images = [(1, 5, "photo", 200, 100, "b"), (1, 5, "photo", 150, 100, "a"), (1, 5, "photo", 100, 100, "c"), (2, 7, "photo", 100, 100, "x"), (2, 7, "grid", 100, 100, "x")]
    for some in (images, images[::-1]):
        df = spark.createDataFrame(some, "doc int, pos int, kind string, w int, h int, src string").coalesce(1)
        assert rows(layout.gallery(df, 96, 2), "doc", "kind", "w", "src", "repeated") == [(1, "photo", 100, "c", False), (1, "photo", 150, "a", False), (2, "grid", 100, "x", False)]


def test_boxes_that_nothing_reaches_meet_no_grid(spark):
    """A page with one pair among boxes of its own: the pair merges, and the grid sees nothing else."""
    boxes = [(1, 0, i, 1000.0 * i, 0.0, 1000.0 * i + 1e12 * (i == 40), 60.0) for i in range(41)] + [(1, 0, 100, 5.0, 0.0, 90.0, 60.0), (2, 0, 0, 0.0, 0.0, 50.0, 50.0)]
    df = spark.createDataFrame(boxes, "doc int, page int, box int, x0 double, y0 double, x1 double, y1 double")
    got = layout.merge_boxes(df, least_side=0.0, least_paths=1)
    assert rows(got.where("paths > 1"), "doc", "page", "x0", "x1", "paths") == [(1, 0, 0.0, 90.0, 2)]
    assert got.count() == 42


def test_costs_and_tools_are_read_in_one_pass(spark):
    """The stock is read once for costs, and tools of projects are not grouped; both give what a plain sum and search give."""
    m = lambda **q: {int(k[1:]): v for k, v in q.items()}
    yarns = spark.createDataFrame([(1, "2,5", "", m(p1=1.0, p2=0.005), m(p1=0.5)), (2, None, "USD", None, m(p1=3.0)), (3, "x", "EUR", m(p2=0.001), None)], "id long, price string, currency string, reservations map<long,double>, consumed map<long,double>")
    cost = stock.project_cost(yarns, "EUR")
    assert rows(cost, "project_id", "currency", "amount", "priced", "unpriced") == [(1, "EUR", 3.75, 1, 0), (1, "USD", 0.0, 0, 1), (2, "EUR", 0.03, 1, 0)]
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan(cost)
    linked = tools.linked_tools(spark.createDataFrame([(1, [7, 8, 7, None, 9]), (2, []), (3, None)], "id int, tool_ids array<int>"), spark.createDataFrame([(7, "a"), (9, "b")], "id int, name string"))
    assert rows(linked, "project_id", "tool_id", "place", "name") == [(1, 7, 0, "a"), (1, 9, 4, "b")]
    assert "Aggregate" not in plan(linked)
