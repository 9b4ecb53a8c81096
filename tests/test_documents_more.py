"""Fibres, exports, layout and instruction lines."""

from pyspark.sql import functions as F

from loomspan.functions import fibres
from loomspan.operators import exports, layout, steps


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_fibres(spark):
    data = [(1, ["Mérinos", "soie"]), (2, ["80 % laine / 20 % polyamide"]), (3, ["mystery"]), (4, []), (5, ["100 %"]), (6, ["baby alpaca", "coton bio"]), (7, None)]
    df = spark.createDataFrame(data, "id int, c array<string>").select("id", fibres.origin_key(F.col("c")).alias("k"), fibres.animal_entries(F.col("c")).alias("a"))
    assert rows(df, "id", "k") == [(1, "animal"), (2, "mixed"), (3, "incomplete"), (4, None), (5, None), (6, "mixed"), (7, None)]
    assert rows(df.where("id IN (2, 6)"), "a") == [(["80 % laine / 20 % polyamide"],), (["baby alpaca"],)]
    lab = spark.createDataFrame([([" GOTS", "vegan", "x", "gots"],)], "l array<string>")
    assert lab.select(fibres.labels(F.col("l")).alias("x")).first()["x"] == ["gots", "vegan"]
    assert lab.select(fibres.ordered_labels(F.col("l")).alias("x")).first()["x"] == ["vegan", "gots"]
    cable = spark.createDataFrame([("80|s",), ("80|",), ("x|s",)], "v string").select(fibres.cable(F.col("v")).alias("x"))
    assert [tuple(r["x"]) if r["x"] else None for r in cable.collect()] == [(80.0, "s"), (80.0, None), None]


def test_sizes(spark):
    asked = spark.createDataFrame([(1, "4,5 mm", ""), (2, "", "7"), (3, "thin", "7"), (4, "", "99")], "id int, mm string, us string")
    assert rows(exports.requested_mm(asked), "id", "size_mm") == [(1, 4.5), (2, 4.5), (3, None), (4, None)]
    tools = spark.createDataFrame([(1, 4.0), (2, 4.1)], "id int, size_mm double")
    assert rows(exports.with_equivalents(tools), "id", "us", "uk") == [(1, "6", "8"), (2, None, None)]
    g = spark.createDataFrame([(4.0, 20.0, 22.0), (4.0, 20.0, 20.2), (0.0, 1.0, 1.0)], "a double, b double, c double")
    assert [r["x"] for r in g.select(exports.recommended_mm(F.col("a"), F.col("b"), F.col("c"), "knitting").alias("x")).collect()] == [3.75, 4.0, None]


def test_layout(spark):
    items = spark.createDataFrame([("d", 0, 50.0, 700.0, "world"), ("d", 0, 10.0, 701.0, "hello"), ("d", 0, 10.0, 680.0, "next")], "doc string, page int, x double, y double, text string")
    assert rows(layout.rows_of(items), "line_no", "text") == [(0, "hello world"), (1, "next")]
    xs = spark.createDataFrame([("d", float(x)) for x in (1, 2, 3, 50, 51)], "doc string, x double")
    assert rows(layout.gaps(xs, 10.0, "doc"), "first_x", "last_x", "n") == [(1.0, 3.0, 3), (50.0, 51.0, 2)]
    box = [("d", 0, i, 10.0 * i, 0.0, 10.0 * i + 8, 50.0) for i in range(10)] + [("d", 0, 99, 500.0, 500.0, 505.0, 505.0), ("d", 1, 5, 0.0, 0.0, 90.0, 90.0)]
    got = layout.merge_boxes(spark.createDataFrame(box, "doc string, page int, box int, x0 double, y0 double, x1 double, y1 double"))
    assert rows(got, "page", "id", "x0", "x1", "paths") == [(0, 0, 0.0, 98.0, 10)]
    raster = spark.createDataFrame([("d", 0, 0.0, 0.0, 98.0, 50.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert layout.without_duplicates(got, raster).count() == 0
    pics = spark.createDataFrame([("d", i, k, w, 100, s) for i, k, w, s in ((0, "photo", 100, "a"), (1, "photo", 100, "a"), (2, "photo", 20, "b"), (3, "grid", 20, "c"), (4, "photo", 100, None))], "doc string, pos int, kind string, w int, h int, src string")
    assert rows(layout.gallery(pics), "pos", "repeated") == [(0, True), (3, False)]


def test_steps(spark):
    lines = spark.createDataFrame([("Cast on 80 (90, 100) sts, then 8 (9, 10) more.",), ("Row 1: knit 5",), ("no numbers",)], "text string")
    got = {r["text"]: (r["t"], r["c"]) for r in steps.with_placeholders(lines, 3).collect()}
    assert got["Cast on 80 (90, 100) sts, then 8 (9, 10) more."] == ("Cast on {{0}} sts, then {{1}} more.", [["80", "90", "100"], ["8", "9", "10"]])
    assert got["Row 1: knit 5"] == ("Row 1: knit 5", [])
    kinds = spark.createDataFrame([("Row 1: knit",), ("Repeat rows 1-2 4 times",), ("Note: x",), ("x" * 5000,)], "v string")
    assert [r["k"] for r in kinds.select(steps.step_type(F.col("v")).alias("k")).collect()] == ["row", "repeat", "note", "text"]
    one = lambda v, e: spark.createDataFrame([(v,)], "v string").select(e(F.col("v")).alias("x")).first()["x"]
    assert one("Design by Ada Lovelace", steps.author) == "Ada Lovelace" and one("knit by hand", steps.author) is None
    assert one("C O Z Y  H A T", steps.despaced) == "COZY HAT" and one("Cozy hat", steps.despaced) == "Cozy hat"
    md = "# Title\n## Body\n- row one\n> careful\nplain\n## Sleeve\n- row two"
    parsed = steps.parse_markdown(spark.createDataFrame([(1, md)], "doc int, text string"))
    assert rows(parsed.where("type = 'bullet'"), "title", "content") == [("Body", "row one"), ("Sleeve", "row two")]
    assert steps.write_markdown(parsed).first()["text"] == md


def test_document_flow(spark):
    from loomspan.operators import documents, progress

    text = lambda i: f"Head\nMATERIALS\nyarn {i} grams\nBODY\nRow {i}: knit all\nplain line {i} words\nfoot {i}"
    lines = documents.lines_of(spark.createDataFrame([("d", i, text(i)) for i in range(3)], "doc string, page int, text string"), "doc", "page", "text")
    got = documents.read_documents(lines, F.col("text").rlike("^[A-Z]{4,}$"), [("material", "supplies"), ("body", "piece")], "other")
    assert rows(got.where("page = 0"), "text", "kind", "type") == [("Row 0: knit all", "piece", "row"), ("plain line 0 words", "piece", "text"), ("yarn 0 grams", "supplies", "text")]
    assert rows(documents.page_subset(lines, [2, 0]).where("line_no = 2"), "page", "text") == [(0, "yarn 2 grams"), (1, "yarn 0 grams")]
    glued = spark.createDataFrame([("k n i t  t h e  n e x t\n" * 30,), ("knit the next\n" * 40,)], "t string")
    assert [r["x"] for r in glued.select(documents.illegible(F.col("t"), "knit").alias("x")).collect()] == [True, False]
    gates = spark.createDataFrame([(False, None, True), (True, "x", False), (False, None, False)], "scanned boolean, reason string, several boolean")
    assert [(r["rejected"], r["reasons"]) for r in documents.rejection(gates).collect()] == [("several", ["several"]), ("scanned", ["scanned", "not_pattern"]), (None, [])]
    k = spark.sql("SELECT array('other', 'knit two', 'then purl') AS k, 'so knit two then purl' AS t").select(documents.continuity(F.col("k"), F.lit(2), F.col("t")).alias("n"))
    assert k.first()["n"] == 1
    off = spark.sql("SELECT array('a', 'b') AS k, 'zzz' AS t").select(documents.continuity(F.col("k"), F.lit(1), F.col("t")).alias("n"))
    assert off.first()["n"] == -1
    st = spark.createDataFrame([(1, 0, True, True, False), (1, 1, False, True, True), (1, 2, False, True, True), (1, 3, True, False, False), (1, 4, False, True, False)], "doc long, pos int, is_chart boolean, visible boolean, tracked boolean")
    assert rows(progress.chart_before(st), "pos", "chart") == [(0, None), (1, 0), (2, None), (3, None), (4, None)]
    gl = spark.createDataFrame([("k2tog = knit two together",), ("A long sentence that is no definition",), ("yo   yarn over",)], "text string")
    assert rows(steps.glossary(gl), "abbreviation", "meaning") == [("k2tog", "knit two together"), ("yo", "yarn over")]


def test_tables_and_spaced_lines(spark):
    from loomspan.operators import documents

    data = [("1 2 3 4 5 " * 10 + "size chart",), ("1 2 3 4 5 " * 10 + "word " * 70,), ("1 2",)]
    df = spark.createDataFrame(data, "t string")
    assert [r["x"] for r in df.select(documents.is_tabular(F.col("t")).alias("x")).collect()] == [True, False, False]
    lines = spark.createDataFrame([("k n i t t w o",), ("k n i t two words here and more",), ("a b c",)], "t string")
    assert [r["x"] for r in lines.select(documents.is_spaced(F.col("t")).alias("x")).collect()] == [True, False, False]
    scored = documents.genre(spark.createDataFrame([(1, "knit purl knit"), (2, "sewing seam"), (3, "nothing")], "id int, text string"), [("k", "knit", 3.0), ("p", "purl", 2.0)], [("s", "sewing", 4.0)], 4.0, 2.0)
    assert rows(scored, "id", "score", "markers", "reason") == [(1, 5.0, "k,p", None), (2, 0.0, "", "other"), (3, 0.0, "", "no_markers")]


def test_lines_shared_by_the_pages_of_a_site_go(spark, tmp_path):
    from loomspan.operators import documents
    from loomspan.plans.catalogue import QUERIES

    html = lambda i: f"\n\n<html><nav>Start</nav>{''.join(f'<p>text {i} {chr(97 + k)}</p>' for k in range(9))}<p>start</p><footer>&copy; site</footer></html>"
    urls = ["http://a.example/x", "HTTPS://u@A.example:80/y?q", "http://a.example", "http://b_c.example/", None, "no address"]
    data = [(i, u, html(chr(112 + i))) for i, u in enumerate(urls)]
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = rows(QUERIES["page_lines"](spark, str(tmp_path)), "doc", "page", "line_no", "text")
    for i, doc in enumerate(["a.example", "a.example", "a.example", "b_c.example", None, None]):
        mine = [r[2:] for r in got if r[:2] == (doc, i)]
        whole = [(0, "Start"), *((k + 1, f"text {chr(112 + i)} {chr(97 + k)}") for k in range(9)), (10, "start"), (11, "© site" if False else "&copy; site")]
        assert sorted(mine) == (whole[1:-1] if i < 3 else whole)
    ten = spark.createDataFrame([("d", p, n, "head" if p < 3 and n == 0 else f"x{chr(97 + p)}") for p in range(21) for n in range(2)], "doc string, page int, line_no int, text string")
    assert documents.repeated_lines(ten).count() == 0 and rows(documents.repeated_lines(ten, one_in=10), "key", "on_pages") == [("head", 3)]


def test_merging_boxes_ends_when_nothing_touches(spark):
    box = [("d", 0, i, 10.0 * i, 0.0, 10.0 * i + 8, 50.0) for i in range(100)]
    # the outline of the first two of page 1 reaches the third, which neither of them touches
    box += [("d", 1, 0, 0.0, 0.0, 10.0, 100.0), ("d", 1, 1, 15.0, 0.0, 100.0, 10.0), ("d", 1, 2, 60.0, 60.0, 70.0, 70.0), ("d", 1, 3, 200.0, 200.0, 270.0, 270.0)]
    got = layout.merge_boxes(spark.createDataFrame(box, "doc string, page int, box int, x0 double, y0 double, x1 double, y1 double"), least_paths=1)
    assert rows(got, "page", "id", "x0", "x1", "y1", "paths") == [(0, 0, 0.0, 998.0, 50.0, 100), (1, 0, 0.0, 100.0, 100.0, 3), (1, 3, 200.0, 270.0, 270.0, 1)]
