"""Size labels and reference blocks: literal documents, one for each rule."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions.numbers import measures
from loomspan.operators import reference


@pytest.mark.parametrize(
    ("lines", "source", "labels"),
    [
        (["Sizes: S (M, L) XL", "Knit 10 rows"], "line", "S M L XL"),
        (["Sizes", "2 4 6"], "line", "2 4 6"),
        (["Sizes: 2 (4, 6,", "8) years"], "line", "2 4 6 8"),
        (["Sizes:", "S (M,", "L, 2XL)"], "line", "S M L 2XL"),
        (["Größe: 2-4, 6-8 Jahre"], "line", "2-4 6-8"),
        (["Taille unique"], "none", ""),
        (["xs s m", "text"], "header", "XS S M"),
        (["S/M L/XL"], "header", "S/M L/XL"),
        (["S: knit 2", "M: knit 3", "S: purl", "M: purl"], "prefix", "S M"),
        (["S: knit 2", "M: knit 3", "S: purl"], "none", ""),
        (["1 (2, 3)", "4 (5, 6)", "7 (8, 9) x", "1 (2)"], "modal", "T1 T2 T3"),
        (["the sizes are S M", None, "x" * 5000], "none", ""),
    ],
)
def test_size_labels(spark, lines, source, labels):
    df = spark.createDataFrame([("d", 0, i, t) for i, t in enumerate(lines)], "doc string, page int, line_no int, text string")
    (row,) = reference.size_labels(df).collect()
    assert (row["source"], " ".join(row["labels"])) == (source, labels)


def block(spark, *lines):
    df = spark.createDataFrame([("d", 0, i, t) for i, t in enumerate(lines)], "doc string, page int, line_no int, text string")
    rows = reference.reference_block(df).collect()
    return {k: v for k, v in rows[0].asDict().items() if v and k != "doc"} if rows else {}


def test_lines_are_told_by_words_and_measures(spark):
    assert block(
        spark, "20 sts and 28 rows = 10 cm", "Hook size US 7", "Needles 4 mm and 4,5 mm", "Wool yarn, 100 g / 200 m", "k2tog = knit two together", "k2tog = knit two sts", "4 in makes 12 stitches", "10.5 cm and 3 sts", "needles of wood",
    ) == {"gauge": "20 sts and 28 rows = 10 cm", "needles": ["Hook size US 7", "Needles 4 mm and 4,5 mm"], "yarns": ["Wool yarn, 100 g / 200 m"], "abbreviations": ["k2tog = knit two together"], "notes": ["k2tog = knit two sts"]}


def test_labels_open_blocks(spark):
    assert block(spark, "Gauge: 20 sts", "28 rows = 10 cm", "Needles: 4 mm", "Yarn:", "Nova", "Drops, 2 balls.", "Knit to end") == {"gauge": "20 sts 28 rows = 10 cm", "needles": ["4 mm"], "yarns": ["Nova", "Drops, 2 balls."]}
    assert block(spark, "Materials:", *"abcdefg") == {"yarns": list("abcd")}
    assert block(spark, "Nothing of the kind", None, "") == {}


def test_measures(spark):
    row = spark.range(1).select(measures(F.lit('4,5 mm, 10cm or 4" and 12')).alias("m")).first()
    assert [tuple(m) for m in row["m"]] == [(4.5, "mm"), (10.0, "cm"), (4.0, '"')]
