"""Titles, sections, captions, tabs and noise on small pages, expectations literal."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import documents, headings
from loomspan.operators.steps import LONGEST, row_start

SCHEMA = "doc string, page int, line_no int, text string, y double, size double, bold boolean, italic boolean, right boolean"


def page(*lines, doc="d", number=0):
    """Lines of (text, options) under each other, 12 units apart."""
    out = []
    for i, line in enumerate(lines):
        text, o = (line, {}) if isinstance(line, str) else line
        out.append((doc, number, i, text, o.get("y", 800.0 - 12 * i), o.get("size", 10.0), o.get("bold", False), o.get("italic", False), o.get("right", False)))
    return out


BODY = "This is a line of the body that is set in ten points and runs on."


@pytest.mark.parametrize(
    ("text", "options", "title"),
    [
        ("Body and sleeves", {"size": 11.5}, True),
        ("Body and sleeves", {"size": 11.4}, False),
        ("Body and sleeves", {"bold": True}, True),
        ("BODY", {}, True),
        ("Body", {"bold": True, "italic": True}, False),
        ("Knit to the end.", {"bold": True}, False),
        ("ok", {"bold": True}, False),
        ("A title that is too long to be one, by a few letters", {"bold": True}, False),
        ("Row 5", {"bold": True}, False),
        ("12 14 16 18", {"bold": True}, False),
        ("(24 stitches)", {"bold": True}, False),
        ("With 4 mm needles:", {"bold": True}, False),
        ("For the body:", {"bold": True}, True),
        ("123", {"bold": True}, False),
    ],
)
def test_titles(spark, text, options, title):
    df = spark.createDataFrame(page(BODY, (text, options), BODY), SCHEMA)
    assert [r["title"] for r in headings.titled_lines(df).where("line_no = 1").collect()] == [title]


def test_sections_fold_titles_that_go_on_and_drop_empty_repeats(spark):
    big = {"size": 14.0}
    lines = page(
        BODY, ("THE LACE", big), ("SHAWL", big), BODY, BODY, ("Notes", {"bold": True}), ("Sleeve", big), ("Cuff", {"size": 20.0}), BODY,
        ("Far", big), ("Apart", {"size": 14.0, "y": 600.0}), ("Notes", {"bold": True, "y": 590.0}), (BODY, {"y": 500.0}),
    ) + page("no title here", doc="e")
    cut = headings.sections(spark.createDataFrame(lines, SCHEMA))
    got = {(r["doc"], r["section"]): (r["title"], r["lines"]) for r in headings.section_list(cut).collect()}
    assert got == {
        ("d", 0): ("", 1), ("d", 1): ("THE LACE SHAWL", 2), ("d", 3): ("Sleeve", 0), ("d", 4): ("Cuff", 1), ("d", 5): ("Far", 0), ("d", 6): ("Apart", 0), ("d", 7): ("Notes", 1), ("e", 0): ("", 1),
    }
    assert cut.where("role = 'more'").count() == 1


def test_running_totals_go_through_many_partitions(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("doc"), (F.col("id") * 7919 % 5003).alias("n"), (F.col("id") % 3).alias("v"))
    got = defaultdict(list)
    for r in headings.running_total(rows.repartition(6), "doc", ["n"], "v", "sum").collect():
        got[r["doc"]].append((r["n"], r["v"], r["sum"]))
    for some in got.values():
        total = 0
        for _, v, s in sorted(some):
            total += v
            assert s == total


def test_body_size_is_that_of_most_characters(spark):
    df = spark.createDataFrame(page(("xx", {"size": 9.0}), ("xx", {"size": 9.0}), ("xxxxxx", {"size": 12.0}), ("yyyyyy", {"size": 11.0})), SCHEMA)
    assert [tuple(r) for r in headings.body_sizes(df).collect()] == [("d", 11.0)]


def test_noise(spark):
    right = {"right": True}
    pages = []
    for n in range(4):
        pages += page(
            f"Head of page {n}", "Row 1: knit", f"Body line {'abcd'[n]} of the page", ("EN", {"y": 500.0 + n * 0.3}), ("DE", {"y": 100.0 * n}), ("fig. one", right), (f"{n} x", right), ("a longer line of the right column it is", right),
            f"see www.shop{n}.example/yarn-", "blue/42", f"Ask the shop that {'abcd'[n]} sold you the", "yarn.", "blue/43", f"Text {'abcd'[n]} then ------", "Row 2: purl", number=n,
        )
    got = {(r["page"], r["text"]) for r in headings.strip_noise(spark.createDataFrame(pages, SCHEMA), tails=[("yarn\\.", "sold you the")]).collect()}
    for n, c in enumerate("abcd"):
        assert {t for p, t in got if p == n} == {
            "Row 1: knit", f"Body line {c} of the page", "DE", f"{n} x", "a longer line of the right column it is", f"see www.shop{n}.example/yarn-", f"Ask the shop that {c} sold you the", "blue/43", f"Text {c} then", "Row 2: purl",
        }


def plain_noise(lines, one_in, tails):
    """``strip_noise`` by one join a rule, over the operators that find heads, captions and tabs each for itself."""
    on_page = Window.partitionBy("doc", "page").orderBy("line_no")
    before, t = F.trim(F.lag("text").over(on_page)), F.trim("text")
    drop = F.coalesce(before.rlike(r"(?i)(https?://|www\.)\S+[-/_.=&]$") & ~t.rlike(r"\s") & t.rlike(r"[/.=&?_-]"), F.lit(False))
    for what, after in tails:
        drop = drop | F.coalesce(t.rlike(f"(?i)^(?:{what})$") & before.rlike(f"(?i)(?:{after})\\s*$"), F.lit(False))
    key = documents.line_key(F.col("text"))
    kept = documents.with_edge(lines.withColumn("_drop", drop)).withColumn("_key", key).where("NOT _drop").join(headings.tab_lines(lines), ["doc", "page", "line_no"], "left_anti")
    heads = documents.repeated_lines(lines, one_in).select("doc", F.col("key").alias("_key"), F.lit(True).alias("_head"))
    captions = headings.caption_keys(lines).select("doc", F.col("key").alias("_key"), F.lit(True).alias("_caption"))
    told = kept.join(heads, ["doc", "_key"], "left").join(captions, ["doc", "_key"], "left")
    said = told.where(~(F.coalesce("_head", F.lit(False)) & F.col("_edge") & ~F.coalesce(row_start(F.col("text")), F.lit(False))) & F.col("_caption").isNull())
    shortened = F.when(F.length("text") <= LONGEST, F.regexp_replace("text", r"\s*[-–—_]{6,}\s*$", "")).otherwise(F.col("text"))
    return said.withColumn("text", shortened).where(F.trim("text") != "").select(*lines.columns)


def test_noise_is_that_of_one_join_a_rule_and_lines_are_read_once(spark):
    rng = random.Random(9)
    texts = ["EN", " DE ", "EN ------", "------", "Row 5 ------", "row 5", "Head 1", "head  22", "fig. one", "FIG.  ONE", "12 x 3", "1 2 3 4 5 6 7 8 9 a", "x" * 20, "x" * 21, "İ" * 11, "1 " * 30 + "caption", "a" * 4001, "b" * 3994 + "------", "c" * 3995 + "------", "see www.a.b/c-", "d/e", "said the", "yarn.", "end --- ------\t", "end ------\u2028", "end ------\x85", "end \u2003------", "", " ", None]
    rows = [(doc, p, n, rng.choice(texts), rng.choice([None, 10.0, 10.5, 300.0]), None, None, None, rng.choice([True, True, False, None])) for doc in ("a", "b", None) for p in (0, 1, 2, 3, 4, None) for n in range(rng.randint(1, 40))]
    lines = spark.createDataFrame(rows, SCHEMA)
    for one_in in (1, 2, 5):
        got = Counter(headings.strip_noise(lines, one_in, [("yarn\\.", "said the")]).collect())
        assert got == Counter(plain_noise(lines, one_in, [("yarn\\.", "said the")]).collect()) and 0 < got.total() < len(rows)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert headings.strip_noise(lines.mapInArrow(seen, SCHEMA)).count() > 0 and read.value == len(rows)


def test_tabs_stand_at_one_height(spark):
    rng = random.Random(2)
    rows = [("d", p, i, rng.choice(["EN", "DE", "x"]), float(rng.choice([10, 10.4, 10.9, 11.5, 12.0, 50])), 10.0, False, False, False) for p in range(6) for i in range(5)]
    got = {(r["page"], r["line_no"]) for r in headings.tab_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = set()
    for code in ("EN", "DE"):
        run = []
        for r in sorted((r for r in rows if r[3] == code), key=lambda r: r[4]) + [(None, None, None, None, 1e9)]:
            if run and r[4] - run[0][4] > 1:
                want |= {(x[1], x[2]) for x in run} if len({x[1] for x in run}) >= 2 else set()
                run = []
            run.append(r)
    assert got == want and got


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert headings.section_list(headings.sections(none)).count() == 0 and headings.strip_noise(none).count() == 0
