"""Scalar expressions against literal expectations."""

from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import catalogues, dates, fibres, numbers, text


def one(spark, expr, **values):
    kinds = {str: "string", float: "double", int: "int", date: "date"}
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "zero int")
    return row.select(expr.alias("x")).first()["x"]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_parse_decimal(spark):
    raw = ["1,5", "1.5", "", "  ", "x", "1,2,3", None, "-2", "18,90 €", " 7 "]
    assert column(spark, raw, numbers.parse_decimal(F.col("v"))) == [1.5, 1.5, 0.0, 0.0, None, None, None, -2.0, None, 7.0]
    assert column(spark, raw, numbers.has_value(F.col("v"))) == [True, True, False, False, True, True, False, True, True, True]


def test_round2_is_half_up_on_the_binary_value(spark):
    assert column(spark, [0.1 + 0.2, 1.005, -2.5, 2.675, None], numbers.round2(F.col("v")), "double") == [0.3, 1.0, -2.5, 2.68, None]
    assert column(spark, [4.5, 1.005, 3.999], numbers.hundredths(F.col("v")), "double") == [450, 100, 400]


def test_durations(spark):
    secs = [0, 29, 30, 3600, 3660, 5400, None]
    assert column(spark, secs, numbers.minutes_text(F.col("v")), "int") == ["0 min", "0 min", "1 min", "1 h", "1 h 01 min", "1 h 30 min", "0 min"]
    assert column(spark, [5, 65, 3605], numbers.clock_text(F.col("v")), "int") == ["0:05", "1:05", "1:00:05"]


def test_units_and_amounts(spark):
    assert column(spark, [999.4, 999.5, 1500.0], numbers.length_text(F.col("v")), "double") == ["999 m", "1 km", "1.50 km"]
    assert column(spark, [91.44], numbers.length_text(F.col("v"), "imperial"), "double") == ["100 yd"]
    assert column(spark, [50.0, 2000.0], numbers.weight_text(F.col("v")), "double") == ["50 g", "2 kg"]
    assert column(spark, [5.0, 5.5, 0.1 + 0.2], numbers.amount_text(F.col("v")), "double") == ["5", "5.50", "0.30"]
    assert column(spark, ["QUJD", "QUI=", "QQ=="], numbers.base64_bytes(F.col("v"))) == [3, 2, 1]
    assert column(spark, ["12,3,4a", "a1.2"], numbers.keep_decimal_characters(F.col("v"))) == ["12,34", "1.2"]


def test_nearest_and_spread(spark):
    assert column(spark, [3.1, 3.25, None], numbers.nearest([3.0, 3.5, 4.0], F.col("v")), "double") == [3.0, 3.0, None]
    df = spark.createDataFrame([(3, 10), (10, 3)], "o int, r int").select(numbers.spread_over_rows(F.col("o"), F.col("r")).alias("x"))
    got = sorted([tuple(r["x"]) for r in df.collect()], key=str)
    assert got == [(3, 1, None), (None, None, 4)]


def test_text_keys(spark):
    assert column(spark, ["Écru", " ÉCRU ", "ecru", "Ñandú", None], text.fold(F.col("v"))) == ["ecru", "ecru", "ecru", "nandu", None]
    assert column(spark, ["Yarn_Name", "yarn--name ", "Total  Paid"], text.header_key(F.col("v"))) == ["yarn name", "yarn name", "total paid"]
    assert column(spark, ["Été à la mer!", "--", "a" * 80], text.slug(F.col("v"))) == ["ete-a-la-mer", "", "a" * 60]
    assert column(spark, ["Super Bulky (6 wpi)", "Bulky", "DK", "odd"], text.first_keyword(F.col("v"), catalogues.WEIGHT_KEYWORDS)) == ["superbulky", "bulky", "dk", None]
    assert column(spark, ["scarf [12]", "none", "[3] x"], text.trailing_id(F.col("v"))) == [12, None, None]
    assert column(spark, ["a\n\n b \r\nc", None], text.lines(F.col("v"))) == [["a", "b", "c"], []]


def test_csv_guard(spark):
    raw = ["=1+1", "a;b", 'say "x"', "plain", None, "-5", "two\nlines"]
    assert column(spark, raw, text.csv_cell(F.col("v"))) == ["'=1+1", '"a;b"', '"say ""x"""', "plain", "", "'-5", '"two\nlines"']
    assert column(spark, [-5], text.csv_cell(F.col("v"), is_text=False), "int") == ["-5"]


def test_placeholders(spark):
    df = spark.sql("SELECT 'k {{0}} then {{1}}' AS t, array(array('2','3'), array('5')) AS c")
    assert df.select(text.expand_counts(F.col("t"), F.col("c"), F.lit(1)).alias("x")).first()["x"] == "k 3 then "


def test_weeks(spark):
    days = [date(2026, 7, 15), date(2026, 7, 12)]
    assert column(spark, days, dates.week_start(F.col("v")), "date") == [date(2026, 7, 13), date(2026, 7, 6)]
    assert column(spark, days, dates.week_start(F.col("v"), 0), "date") == [date(2026, 7, 12), date(2026, 7, 12)]
    assert column(spark, days, dates.period_key(F.col("v"), "month"), "date") == ["2026-07", "2026-07"]
    assert dates.window_bounds(date(2026, 7, 15)) == (date(2026, 4, 20), date(2026, 7, 15))
    assert dates.window_bounds(date(2026, 7, 15), "quarter", 0)[0] == date(2026, 4, 19)
    assert dates.window_bounds(date(2026, 7, 15), "nonsense") == dates.window_bounds(date(2026, 7, 15))


def test_declared_days(spark):
    raw = ["2026-07-15T10:00:00Z", "9999-01-01", "1000-01-01", "x", None, "2026-13-01"]
    assert column(spark, raw, dates.declared_day(F.col("v"), 2027)) == [date(2026, 7, 15), None, None, None, None, None]
    assert column(spark, ["2024-05-01", "05/01/2024", "2024-05-01 10:00", ""], dates.import_date(F.col("v"))) == [date(2024, 5, 1), None, date(2024, 5, 1), None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20))
def test_round2_matches_the_formula(spark, xs):
    import math

    assert column(spark, xs, numbers.round2(F.col("v")), "double") == [math.floor(x * 100 + 0.5) / 100 for x in xs]


def test_amounts_from_cents_are_those_of_a_pattern(spark):
    values = [0.0, -0.001, 0.005, 1.005, -0.05, -5.0, 12.3, 99.995, -1234.567, 1e12 + 0.25, 3e15, 1e300, float("nan"), None]
    r = numbers.round2(F.col("v"))
    want = F.when(r == F.floor(r), F.format_string("%.0f", r)).otherwise(F.format_string("%.2f", r))
    assert column(spark, values, numbers.amount_text(F.col("v")), "double") == column(spark, values, want, "double")


def test_values_are_computed_once(spark):
    """An expression over a folded token, a typed number or an amount holds it once, however often it is asked for."""
    x = F.concat(F.lit("marker"), F.col("v"))
    held = lambda c: c._jc.toString().count("marker")
    assert held(numbers.keep_decimal_characters(x)) == 1 and held(numbers.to_canonical(x, "length", "imperial")) == 1
    assert held(fibres.known_fibre(x)) == 1 and held(fibres.origin_key(F.array(x))) == 1
    assert column(spark, ["1,2.3,4", "x", ".", "7"], numbers.keep_decimal_characters(F.col("v"))) == ["1,234", "", ".", "7"]
    found = column(spark, ["Mérinos wool", "wool", "merino", "nothing"], F.to_json(fibres.known_fibre(F.col("v"))))
    assert [f and '"name"' in f for f in found] == [True, True, True, None]


def test_labels_in_catalogue_order(spark):
    assert column(spark, ["gots"], F.array_join(fibres.ordered_labels(F.array(F.lit("rws"), F.col("v"), F.lit("vegan"), F.lit("GOTS"))), "|")) == ["vegan|gots|rws"]
