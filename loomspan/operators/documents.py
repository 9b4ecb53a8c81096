"""Line-oriented text dataflow: repeated-line removal, language, genre and legibility gates, similarity (inventory C25,
D43, D44, D45, D46, E20, L1, L2, L3, L4, L5, L6, L7, L9, L10, L11, L12, L13, L15, L16, L17, L19, L27, L34, L35, L38, L45, L52).

A line row has ``doc``, ``page``, ``line_no`` and ``text``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frequent German function words (fixed values) and the least share of words for the gate.
GERMAN = [
    "und", "nicht", "für", "mit", "ist", "sind", "wird", "werden", "wurde", "nach", "der", "die",
    "das", "den", "dem", "eine", "einen", "einem", "einer", "auf", "sich", "im", "zu",
]
GERMAN_SHARE, GERMAN_LEAST_WORDS = 1 / 30, 20
SCANNED_CHARS_PER_PAGE, LONGEST_LINE = 50, 4000


def lines_of(docs: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Lines of texts, numbered from 0; blank ones go."""
    cut = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("line_no", "raw")
    return docs.select(F.col(doc).alias("doc"), F.col(page).alias("page"), cut).select("doc", "page", "line_no", F.trim("raw").alias("text")).where("text <> ''")


def line_key(text: Column) -> Column:
    """Lower case, digits to #, blanks squeezed: what makes two running heads the same line; long lines have none."""
    return F.when(F.length(text) <= LONGEST_LINE, F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+", " ")))


def with_edge(lines: DataFrame, band: float = 0.12) -> DataFrame:
    """Lines with ``_edge``: whether they are within the outer bands of their page, by position."""
    page = Window.partitionBy("doc", "page")
    last, reach = F.max("line_no").over(page), F.floor((F.max("line_no").over(page) + 1) * band)
    return lines.withColumn("_last", last).withColumn("_reach", F.greatest(reach, F.lit(1))).withColumn("_edge", F.expr("line_no < _reach OR line_no > _last - _reach")).drop("_last", "_reach")


def edge_lines(lines: DataFrame, band: float = 0.12) -> DataFrame:
    """Lines within the outer bands of their page, by position."""
    return with_edge(lines, band).where("_edge").drop("_edge")


def repeated_lines(lines: DataFrame, one_in: int = 2) -> DataFrame:
    """Keys of edge lines that stand on at least max(2, one in ``one_in`` of the pages) pages of their document."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    on = edge_lines(lines).withColumn("key", line_key(F.col("text"))).where("key IS NOT NULL").groupBy("doc", "key").agg(F.count_distinct("page").alias("on_pages")).where("on_pages >= 2")
    return on.join(pages, "doc").where(F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / one_in)))


def strip_boilerplate(lines: DataFrame, one_in: int = 2) -> DataFrame:
    """Lines without those that repeat in the outer bands; the same words inside a page stay."""
    marked = with_edge(lines)
    edge = marked.where("_edge").withColumn("key", line_key(F.col("text"))).join(repeated_lines(lines, one_in).select("doc", "key"), ["doc", "key"], "left_anti")
    return marked.where("NOT _edge").select(lines.columns).unionByName(edge.select(lines.columns))


def strip_short(lines: DataFrame, one_in: int = 2) -> DataFrame:
    """As ``strip_boilerplate``, for documents that are short beside a task: rows dealt once by document, and sorted once by page and
    once by key, tell all counts.  A document is one task's here; those of any length take ``strip_boilerplate``."""
    fresh = lambda *by: (F.col("page").isNotNull() & ~F.col("page").eqNullSafe(F.lag("page").over(Window.partitionBy(*by).orderBy("page")))).cast("int")
    dealt = with_edge(lines).withColumn("_fresh", fresh("doc")).withColumn("_pages", F.sum("_fresh").over(Window.partitionBy("doc")))
    keyed = dealt.withColumn("_key", F.when(F.col("_edge"), line_key(F.col("text")))).withColumn("_fresh", fresh("doc", "_key")).withColumn("_on", F.sum("_fresh").over(Window.partitionBy("doc", "_key")))
    repeats = F.col("doc").isNotNull() & F.col("_key").isNotNull() & (F.col("_on") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") / one_in)))
    return keyed.where(~repeats).select(*lines.columns)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_german(text: Column) -> Column:
    """At least one in thirty words is a German function word, of twenty words or more."""
    n = F.size(words(text))
    found = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}])(" + "|".join(GERMAN) + r")(?![\p{L}\p{N}])"), F.lit(0)))
    return F.coalesce((n >= GERMAN_LEAST_WORDS) & (found / n >= GERMAN_SHARE), F.lit(False))


def is_scanned(lines: DataFrame) -> DataFrame:
    """Documents with under 50 characters a page (L4)."""
    per = lines.groupBy("doc").agg((F.sum(F.length("text")) / F.count_distinct("page")).alias("chars_per_page"))
    return per.withColumn("scanned", F.col("chars_per_page") < SCANNED_CHARS_PER_PAGE)


def is_spaced(text: Column) -> Column:
    """Six tokens or more, at least 70 % of them one character."""
    w = words(text)
    return (F.size(w) >= 6) & (F.size(F.filter(w, lambda x: F.length(x) == 1)) >= F.size(w) * 0.7)


#: What counts as a word and as a number in a page of measurements (fixed values).
TABLE_WORD, TABLE_NUMBER = r"^\p{L}{3,}[.,:;!?)]*$", r"^\(?[0-9¼½¾.,/%-]+\)?$"


def is_tabular(text: Column) -> Column:
    """Under 60 words, at least 40 numbers and twice as many numbers as words."""
    w = words(text)
    numbers, plain = F.size(F.filter(w, lambda x: x.rlike(TABLE_NUMBER))), F.size(F.filter(w, lambda x: x.rlike(TABLE_WORD)))
    return (plain < 60) & (numbers >= 40) & (numbers >= plain * 2)


def marker_score(docs: DataFrame, markers: list[tuple[str, str, float]], text: str = "text") -> DataFrame:
    """Sum of the weights of distinct markers (id, pattern, weight) that a text holds."""
    hits = F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("w"))) for i, p, w in markers))
    found = F.array_compact(hits)
    return docs.withColumn("score", F.aggregate(found, F.lit(0.0), lambda a, x: a + x["w"])).withColumn("markers", F.array_join(F.transform(found, lambda x: x["id"]), ","))


def genre(docs: DataFrame, markers: list[tuple[str, str, float]], contra: list[tuple[str, str, float]], least: float, margin: float, text: str = "text") -> DataFrame:
    """First gate that fails: illegible or tabular texts get no verdict, then another genre, then too few markers."""
    scored = marker_score(marker_score(docs, contra, text).withColumnRenamed("score", "contra").drop("markers"), markers, text)
    reason = (
        F.when(is_spaced(F.col(text)), None).when(is_tabular(F.col(text)) & (F.col("contra") == 0), None)
        .when((F.col("contra") > 0) & (F.col("contra") >= F.col("score") + margin), "other")
        .when(F.col("score") < least, F.when(F.col("contra") > 0, "other").otherwise("no_markers"))
    )
    return scored.withColumn("reason", reason)


def number_duplicates(sections: DataFrame) -> DataFrame:
    """Titles that occur more than once in a document get a running number."""
    same = Window.partitionBy("doc", "title")
    n, k = F.count(F.lit(1)).over(same), F.row_number().over(same.orderBy("pos"))
    return sections.withColumn("numbered", F.when(n > 1, F.concat_ws(" ", "title", k.cast("string"))).otherwise(F.col("title")))


def segment(lines: DataFrame, is_title: Column) -> DataFrame:
    """Section number of every line: 0 before the first title, then one more at each title."""
    order = Window.partitionBy("doc").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.coalesce(is_title.cast("int"), F.lit(0))).over(order))


def title_kind(title: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Kind of the first pattern that the title matches."""
    out = None
    for pattern, kind in rules:
        hit = F.lower(title).rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(other)


def active_section(events: DataFrame, points: DataFrame) -> DataFrame:
    """As-of lookup: for each point the section of the last title at or before it in reading order.

    Both have doc, page and y; titles and points are merged in order and the last title carried forward.
    """
    both = events.select("doc", "page", "y", F.lit(0).alias("side"), "section", F.lit(None).cast("long").alias("point")).unionByName(
        points.select("doc", "page", "y", F.lit(1).alias("side"), F.lit(None).cast("long").alias("section"), F.col("id").alias("point"))
    )
    order = Window.partitionBy("doc").orderBy("page", "y", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("active", F.last("section", ignorenulls=True).over(order)).where("side = 1").select("doc", F.col("point").alias("id"), F.col("active").alias("section"))


def upper_median(values: Column) -> Column:
    """Element at half the length of the sorted list."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def confidence(df: DataFrame) -> DataFrame:
    """Weighted score of known sections, structured lines, good vectors and warnings, and its level."""
    steps = F.when(F.col("total_lines") > 0, F.col("structured_lines") / F.col("total_lines")).otherwise(0.0)
    parts = (
        0.3 * F.when(F.col("sections_total") > 0, F.col("sections_known") / F.col("sections_total")).otherwise(0.0) + 0.3 * steps
        + 0.2 * F.when(F.col("vectors_seen") > 0, F.col("vectors_ok") / F.col("vectors_seen")).otherwise(1.0)
        + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("warnings") / 10)
    )
    score = F.floor(100 * parts + 0.5).cast("int")
    return df.withColumn("confidence", score).withColumn("level", F.when(steps == 0, "low").when(F.col("confidence") >= 70, "high").when(F.col("confidence") >= 40, "medium").otherwise("low"))


def common_lines(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of lines, bit-parallel: a column of the table is one whole number with a bit a
    line of ``a``, so the cost is len(b) times len(a) / 64 words."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    left = whole  # a cleared bit is a step of the subsequence
    for y in b:
        hit = left & at.get(y, 0)
        left = (left + hit | left - hit) & whole
    return len(a) - left.bit_count()


def similarity(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Share of common lines of two texts, and lines missing and extra (L35).  A pair costs its lines multiplied, by 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda t: [s for s in (x.strip() for x in (t or "").split("\n")) if s]
        for batch in batches:
            rows = [(cut(a), cut(b)) for a, b in zip(batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True)]
            lcs = [common_lines(a, b) for a, b in rows]
            ratio = [math.floor(200_000 * n / (len(a) + len(b)) + 0.5) / 100_000 if a or b else 1.0 for n, (a, b) in zip(lcs, rows, strict=True)]
            more = [pa.array(ratio), pa.array([len(b) - n for n, (_, b) in zip(lcs, rows, strict=True)], pa.int64()), pa.array([len(a) - n for n, (a, _) in zip(lcs, rows, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "ratio", "missing", "extra"])

    kept = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.mapInArrow(run, f"{kept}, ratio double, missing long, extra long")


def reflow(lines: DataFrame, most: int = 60) -> DataFrame:
    """Wrapped lines joined into paragraphs: a line goes on if the one before ends no sentence and this one does not
    start with a capital or a list mark (L19).  Islands of a running flag, so every paragraph is one group."""
    order = Window.partitionBy("doc", "page").orderBy("line_no")
    before = F.lag("text").over(order)
    goes_on = before.isNotNull() & ~before.rlike(r"[.!?:;]$") & ~F.col("text").rlike(r"^(\p{Lu}|[-*•]|[0-9]+[.)])") & (F.length(before) >= most // 2)
    part = F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    grouped = lines.withColumn("paragraph", part).groupBy("doc", "page", "paragraph").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    return grouped.select("doc", "page", "paragraph", F.array_join(F.transform("x", lambda s: s["text"]), " ").alias("text"))


def page_subset(lines: DataFrame, chosen: list[int]) -> DataFrame:
    """Chosen pages only, numbered from 0 in the order given (L2)."""
    place = F.array_position(F.array(*map(F.lit, chosen)), F.col("page"))
    return lines.withColumn("page", (place - 1).cast("int")).where("page >= 0")


def illegible(text: Column, stem: str, contra: str = "(?!)", least_chars: int = 300, share: float = 0.6) -> Column:
    """Letter-spaced text: spaced lines hold 300 characters or more and at least 60 % of all, and what they say without
    blanks holds a stem of the genre and none of another (L5)."""
    lines = F.split(text, "\n")
    spaced = F.filter(lines, lambda s: is_spaced(s))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, s: n + F.length(s))
    letters = F.array_join(F.transform(spaced, lambda s: F.regexp_replace(s, r"\s+", "")), "\n")
    enough = (size(lines) > 0) & (size(spaced) >= least_chars) & (size(spaced) >= size(lines) * share)
    return F.coalesce(enough & letters.rlike(f"(?iu){stem}") & ~letters.rlike(f"(?iu){contra}"), F.lit(False))


def caption_pages(lines: DataFrame, short: int = 20) -> DataFrame:
    """Pages most of whose right-column lines are short: captions, not prose (L13).  ``lines`` has ``right``."""
    return lines.where("right").groupBy("doc", "page").agg(F.avg((F.length("text") <= short).cast("int")).alias("share")).where("share > 0.5").select("doc", "page")


def multi_column_pages(lines: DataFrame) -> DataFrame:
    """Pages with a line in several columns, a document (D45).  ``lines`` has ``multi``."""
    return lines.groupBy("doc", "page").agg(F.max("multi").alias("m")).groupBy("doc").agg(F.count_if("m").alias("pages"))


def rejection(docs: DataFrame) -> DataFrame:
    """First failing gate and all reasons (L3, L9).  ``docs`` has scanned, reason (of the genre gate) and several."""
    gates = F.array(F.when(F.col("scanned"), "scanned"), F.when(F.col("reason").isNotNull(), "not_pattern"), F.when(F.col("several"), "several"))
    found = F.array_compact(gates)
    return docs.withColumn("reasons", found).withColumn("rejected", F.try_element_at(found, F.lit(1)))


def continuity(keys: Column, anchor: Column, text: Column, most: int = 8) -> Column:
    """-1 if the line at ``anchor`` (from 0) is not in the step's text, else how many lines before it, eight at most, can be
    put in front with the whole still in that text (L34)."""
    tail = F.try_element_at(keys, (anchor + 1).cast("int"))
    before = F.slice(F.reverse(F.slice(keys, F.lit(1), anchor)), 1, most)
    start = F.struct(tail.alias("tail"), F.lit(0).alias("n"), F.lit(True).alias("on"))
    longer = lambda a, k: F.when(k == "", a["tail"]).otherwise(F.concat_ws(" ", k, a["tail"]))
    walked = F.aggregate(
        before, start,
        lambda a, k: F.when(a["on"] & F.contains(text, longer(a, k)), F.struct(longer(a, k).alias("tail"), (a["n"] + 1).alias("n"), F.lit(True).alias("on")))
        .otherwise(F.struct(a["tail"].alias("tail"), a["n"].alias("n"), F.lit(False).alias("on"))),
    )
    there = (F.coalesce(tail, F.lit("")) != "") & F.contains(text, tail)
    return F.when(F.coalesce(there, F.lit(False)), walked["n"]).otherwise(-1)


def read_documents(lines: DataFrame, is_title: Column, kinds: list[tuple[str, str]], other: str) -> DataFrame:
    """The whole flow over lines: repeated lines go, sections are cut at titles and get a kind, lines get a type."""
    from loomspan.operators.steps import step_type

    kept = segment(strip_boilerplate(lines), is_title)
    titles = kept.where(is_title).select("doc", "section", F.col("text").alias("title"))
    named = kept.where(~F.coalesce(is_title, F.lit(False))).join(titles, ["doc", "section"], "left")
    return named.withColumn("kind", title_kind(F.coalesce("title", F.lit("")), kinds, other)).withColumn("type", step_type(F.col("text")))
