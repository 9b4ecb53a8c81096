"""Logical lines by a fold, and size vectors by families: literal cases, and plain versions over whole tables."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomspan.operators import reflow, vectors
from loomspan.operators.documents import lines_of

SF = "/root/testdata/sf0.001"


def folded(spark, texts, **options):
    rows = [("d", 0, i, t if isinstance(t, str) else t[0], None if isinstance(t, str) else float(t[1]), 10.0, False) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc string, page int, line_no int, text string, y double, size double, bold boolean")
    return [r["text"] for r in reflow.reflow_lines(df, **options).orderBy("line_no").collect()]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["Knit to the end of", "Row 5."], ["Knit to the end of Row 5."]),
        (["Knit to the end.", "and turn."], ["Knit to the end.", "and turn."]),
        (["Work 3 sts.", "more sts."], ["Work 3 sts. more sts."]),
        (["Continue straight", "until it measures", "10 cm."], ["Continue straight until it measures", "10 cm."]),
        (["Cast on 80 (90, 100,", "110) stitches.", "Next"], ["Cast on 80 (90, 100, 110) stitches.", "Next"]),
        # the bracket was opened two lines before, which only the gathered text tells
        (["Sizes (small", "and medium", "Large too) are given"], ["Sizes (small and medium Large too) are given"]),
        (["Sizes (small", "Yarn: blue"], ["Sizes (small", "Yarn: blue"]),
        (["Tools", "- one", "- two"], ["Tools", "- one", "- two"]),
        (["see (https://a.b/c-", "d/e) for more"], ["see (https://a.b/c- d/e) for more"]),
        (["see (https://a.b/c-", "d/e.html"], ["see (https://a.b/c-d/e.html"]),
        (["all of the", "Copyright 2026"], ["all of the", "Copyright 2026"]),
        (["Sizes:", "(S, M)"], ["Sizes: (S, M)"]),
        (["One", "Two"], ["One", "Two"]),
    ],
)
def test_reflow_cases(spark, lines, want):
    assert folded(spark, lines) == want


def test_paragraph_mode_looks_at_the_distance(spark):
    lines = [("One", 100), ("Two", 88), ("Three", 60), ("- four", 50)]
    assert folded(spark, lines, paragraphs=True) == ["One Two", "Three", "- four"]
    assert folded(spark, lines) == ["One", "Two", "Three", "- four"]


def test_keys_are_folded_apart_and_empty_tables_give_nothing(spark):
    df = spark.createDataFrame([("a", 0, 0, "to the"), ("a", 1, 0, "end"), ("b", 0, 0, "End"), ("b", 0, 1, " "), ("b", 0, 2, None), ("b", 0, 3, "of it")], "doc string, page int, line_no int, text string")
    assert sorted((r["doc"], r["page"], r["text"], r["lines"]) for r in reflow.reflow_lines(df).collect()) == [("a", 0, "to the", 1), ("a", 1, "end", 1), ("b", 0, "End of it", 2)]
    assert reflow.reflow_lines(df.where("false")).count() == 0


def plain_fold(texts):
    """Text by text, looking at the whole of what has been gathered each time."""
    out = []
    for i, t in enumerate(texts):
        after = texts[i + 1] if i + 1 < len(texts) else None
        if out:
            so_far = reflow.Gathered(reflow.Line((), 0, out[-1], None, None, False))
            between = reflow.glue(so_far, reflow.Line((), 0, t, None, None, False), after, False)
            if between is not None:
                out[-1] += between + t.strip()
                continue
        out.append(t.strip())
    return out


def test_reflow_over_whole_documents_equals_a_plain_fold(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # so that logical lines cross the ends of batches
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.regexp_replace("text", r"((?:\S+\s+){6})", "$1\n"))
        lines = lines_of(docs, "doc_id", "doc_id", "text").cache()
        got = {}
        for r in reflow.reflow_lines(lines, keys=("doc",), most=5).orderBy("doc", "line_no").collect():
            got.setdefault(r["doc"], []).append(r["text"])
        texts = {}
        for r in lines.orderBy("doc", "line_no").collect():
            texts.setdefault(r["doc"], []).append(r["text"])
        assert got == {d: plain_fold(t) for d, t in texts.items()}
        assert sum(map(len, got.values())) < 0.9 * sum(map(len, texts.values()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


VECTORS = [
    ("Cast on 80 (90, 100, 110) sts", [("group", "80 (90, 100, 110)", "80 90 100 110")]),
    ("80 (90, 100) 110", [("group", "80 (90, 100) 110", "80 90 100 110")]),
    ("10 (12) 14 (16) 18", [("group", "10 (12) 14 (16) 18", "10 12 14 16 18")]),
    ("12 34 (56; 78) 90, 91 sts", [("group", "12 34 (56; 78) 90, 91", "12 34 56 78 90 91")]),
    ("4 [6:8:10] in", [("group", "4 [6:8:10]", "4 6 8 10")]),
    ("3 - 4 (5 - 6)", [("group", "3 - 4 (5 - 6)", "3-4 5-6")]),
    ("2.5 (3,5, 4)", [("group", "2.5 (3,5, 4)", "2.5 3,5 4")]),
    ("6, [10, 14], 20", [("list", "6, [10, 14], 20", "6 10 14 20")]),
    ("6,10[14,20]", []),
    ("3 (-, 4, 5)", [("dashed", "3 (-, 4, 5)", "3 - 4 5")]),
    ("knit 2 (-; 3; –) 4", [("dashed", "2 (-; 3; –) 4", "2 - 3 – 4")]),
    ("(-, -)", []),
    ("80/90/100 cm", [("slash", "80/90/100", "80 90 100")]),
    ("1/2", []),
    ("1/2/", []),
    ("80-90-100", [("dash", "80-90-100", "80 90 100")]),
    ("3-2-1 (2-2) 4-5", [("group", "2-1 (2-2) 4-5", "2-1 2-2 4-5")]),
    ("1-2", []),
    ("x 4 (5)", []),
    ("knit × 3 (4, 5)", []),
    ("max 3 (4, 5)", [("group", "3 (4, 5)", "3 4 5")]),
    ("colour 5 (123)", []),
    ("5 (123)", [("group", "5 (123)", "5 123")]),
    ("80 (90) then 1/2/3", [("group", "80 (90)", "80 90"), ("slash", "1/2/3", "1 2 3")]),
    ("80 (90) 1/2/3", [("group", "80 (90) 1", "80 90 1")]),  # the group stands first, the slashes yield
    ("6, (10, 14), 20 (-, 5)", [("list", "6, (10, 14), 20", "6 10 14 20")]),  # the dashed one would reach out of it
    ("2 (3) (-, 4)", [("dashed", "2 (3) (-, 4)", "2 3 - 4")]),  # a group within gives way
    ("", []),
    ("no digits", []),
]


@pytest.mark.parametrize(("line", "want"), VECTORS)
def test_families_and_overlaps(line, want):
    assert [(v.family, line[v.start : v.end], " ".join(v.values)) for v in vectors.find_vectors(line)] == want


def test_vectors_stay_apart_and_are_read_in_the_table_as_alone(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice("0123456789 ()[],;:/-–xab.") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "9" * 5000, "1 " * 3000 + "(2, 3)"]
    for t in lines[:3000]:
        found = vectors.find_vectors(t)
        assert all(a.end <= b.start for a, b in zip(found, found[1:]))
        for v in found:
            inside = "".join(t[v.start : v.end].split())
            assert len(v.values) >= 2 and all(x in inside for x in v.values) and t[v.start : v.end] == t[v.start : v.end].strip()
            digits = "".join(c for x in v.values for c in x if c.isdecimal())
            assert digits == "".join(c for c in inside if c.isdecimal())
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    got = {r["id"]: [tuple(v) for v in r["vectors"]] for r in vectors.size_vectors(df).collect()}
    assert got == {i: [tuple(v) for v in vectors.find_vectors(t or "")] for i, t in enumerate(lines)}


def test_placeholders(spark):
    df = spark.createDataFrame([(1, "Cast on 80 (90, 100) sts, 4 (5) and 1/2/3", 3), (2, "80 (90)", 1), (3, None, 2), (4, "80 (90)", None)], "id int, text string, sizes int")
    got = {r["id"]: (r["t"], r["c"]) for r in vectors.placeholder_lines(df).collect()}
    assert got == {1: ("Cast on {{0}} sts, 4 (5) and {{1}}", [["80", "90", "100"], ["1", "2", "3"]]), 2: ("80 (90)", []), 3: ("", []), 4: ("80 (90)", [])}


def test_last_word_costs_its_own_length():
    """From the end of the text, so that words before it are not tried."""
    from loomspan.operators.reflow import last_word

    for text in ("a b", "a b \t", "word", "", "  ", "x y", "x y\n", "a(http://b"):
        found = re.search(r"(\S+)\s*$", text)
        assert last_word(text) == (found[1] if found else "")
    began = time.perf_counter()
    assert last_word("x" * 30_000 + " y" + "\t" * 30_000 + "z w") == "w"
    assert time.perf_counter() - began < 0.5
