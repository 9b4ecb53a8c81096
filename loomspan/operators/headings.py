"""Titles, sections and noise of set documents (inventory L11, L13, L15, L17).

Lines have doc, page, line_no and text, and may have y, size, bold, italic and right (whether they stand in the right column).
Titles are told by their type against that of the body; sections are running totals of titles, added up over ranges of
lines, so a document of any length is counted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.documents import line_key, with_edge
from loomspan.operators.lineage import cut
from loomspan.operators.steps import LONGEST, row_start, table_row

# How much larger than the body a title is set, its length in characters, how far apart its lines may stand (in
# heights of their type); short captions and how often they must come; pages a tab must stand on, and how exactly.
TITLE_RATIO, SHORTEST, LONGEST_TITLE, TITLE_GAP = 1.15, 3, 42, 2.0
CAPTION_LENGTH, CAPTION_TIMES, TAB_PAGES, TAB_HEIGHT = 20, 3, 2, 1.0
#: A line of numbers is no caption.
NUMBERS = r"^[0-9][0-9.,/x×\s-]*$"
#: At most ``CAPTION_LENGTH`` characters that are no digits or blanks; what the end of a line can be that a rule of dashes closes.
BRIEF = rf"\A[\s0-9]*+(?:[^\s0-9][\s0-9]*+){{0,{CAPTION_LENGTH}}}+\z"
RULE_ENDS = tuple("-–—_\t\n\x0b\f\r\x85\u2028\u2029")
#: Codes that tabs of languages bear.
TABS = ("FR", "EN", "GB", "UK", "US", "DE", "NL", "DA", "DK", "NO", "SV", "SE", "FI", "ES", "IT", "PT", "PL", "CS", "CZ", "HU", "IS", "ET", "LV", "LT", "RU", "JA", "JP", "ZH", "CN", "KO")


def running_total(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over those of ``key`` up to and including each, in ``order``.

    As ``assembly.renumber``: rows are dealt by ranges and written once, each partition adds up its own, and what stands before
    a partition is one number a key.
    """
    held = cut(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    own = F.sum(value).over(Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    added = held.withColumn("_own", own).join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return added.withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_at", "_own", "_key", "_of", "_before")


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc, body: the size in which most characters of a document are set, the smaller of equals."""
    sizes = lines.where("size > 0").groupBy("doc", "size").agg(F.sum(F.length("text")).alias("n"))
    return sizes.groupBy("doc").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def is_title(text: Column, size: Column, body: Column, bold: Column, italic: Column) -> Column:
    """Whether a line is a title (L17): 3 to 42 characters, upright, and bold, in capitals or 1.15 times as large as the body; no end of
    a sentence, row, table row, lone number, count in brackets or announcement of a tool's size."""
    t = F.trim(text)
    stands_out = F.coalesce(bold, F.lit(False)) | ((t == F.upper(t)) & (t != F.lower(t))) | F.coalesce(size >= body * TITLE_RATIO, F.lit(False))
    last = F.substring(t, -1, 1)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    says_nothing = letters < 2
    tool = (last == ":") & F.lower(t).rlike(r"[0-9]\s*mm\b")
    counted = t.startswith("(") & (last == ")")
    fits = F.length(t).between(SHORTEST, LONGEST_TITLE) & ~last.isin(".", "!", "?") & ~says_nothing & ~tool & ~counted
    return F.coalesce(fits & stands_out & ~F.coalesce(italic, F.lit(False)) & ~F.coalesce(row_start(t) | table_row(t), F.lit(False)), F.lit(False))


def _whole(lines: DataFrame) -> DataFrame:
    for c, t in (("y", "double"), ("size", "double"), ("bold", "boolean"), ("italic", "boolean"), ("right", "boolean")):
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(None).cast(t))
    return lines


def titled_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``title``, by the body size of their document."""
    known = _whole(lines)
    flag = is_title(F.col("text"), F.col("size"), F.col("body"), F.col("bold"), F.col("italic"))
    return known.join(body_sizes(known), "doc", "left").withColumn("title", flag).drop("body")


def sections(lines: DataFrame) -> DataFrame:
    """Lines with ``section`` and ``role`` (title, more or body); section 0 is what stands before the first title.

    A title line right below another on the same page, not more than two heights of its type away where heights are known and
    of about the same size, goes on with that title instead of opening a section of its own.
    """
    marked = titled_lines(lines)
    order = Window.partitionBy("doc", "page").orderBy("line_no")
    above = F.lag(F.struct("title", "y", "size", "line_no")).over(order)
    near = F.coalesce(F.col("_a.y") - F.col("y") <= TITLE_GAP * F.coalesce("size", F.lit(10.0)), F.lit(True))
    alike = F.coalesce(F.abs(F.col("size") - F.col("_a.size")) <= 0.1 * F.col("size"), F.lit(True))
    told = marked.withColumn("_a", above).withColumn("more", F.col("title") & F.coalesce(F.col("_a.title"), F.lit(False)) & (F.col("line_no") == F.col("_a.line_no") + 1) & near & alike)
    opened = told.withColumn("_opens", (F.col("title") & ~F.col("more")).cast("long"))
    numbered = running_total(opened, "doc", ["page", "line_no"], "_opens", "section")
    role = F.when(F.col("more"), "more").when(F.col("title"), "title").otherwise("body")
    return numbered.withColumn("role", role).select(*lines.columns, "section", "role")


def section_list(cut_lines: DataFrame) -> DataFrame:
    """doc, section, title (its lines joined) and lines of the body, from lines that ``sections`` has marked.  A section without a
    body is kept; one whose title a later section of the document repeats and that has no body itself is noise and goes."""
    head = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") != "body", F.struct("page", "line_no", F.trim("text").alias("t"))))), lambda s: s["t"]), " ")
    found = cut_lines.groupBy("doc", "section").agg(head.alias("title"), F.count_if(F.col("role") == "body").alias("lines"))
    later = F.max("section").over(Window.partitionBy("doc", F.lower("title")))
    return found.withColumn("_later", later).where((F.col("lines") > 0) | (F.col("_later") == F.col("section"))).drop("_later")


def caption_keys(lines: DataFrame) -> DataFrame:
    """doc, key: short lines of the right column that come three times or more on pages where most of that column is short."""
    right = lines.where("right").withColumn("key", line_key(F.col("text")))
    pages = right.groupBy("doc", "page").agg(F.count_if(F.length("key") <= CAPTION_LENGTH).alias("short"), F.count(F.lit(1)).alias("n")).where("short * 2 > n").select("doc", "page")
    told = right.where((F.length("key") <= CAPTION_LENGTH) & ~F.col("text").rlike(NUMBERS))
    return told.join(pages, ["doc", "page"], "left_semi").groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CAPTION_TIMES).select("doc", "key")


def tab_lines(lines: DataFrame, codes: tuple[str, ...] = TABS) -> DataFrame:
    """doc, page, line_no of lines that are a language's code and nothing else, at one height on two pages or more.

    Lines of a code are taken from the foot up; as long as one is within a unit of the lowest of its run it belongs to that
    run.  A code stands on a page a few times at most, so its lines of a document are few.
    """
    held = lines.withColumn("code", F.trim("text")).where(F.col("code").isin(*codes)).withColumn("h", F.coalesce("y", F.lit(0.0)))
    start = F.struct(F.lit(None).cast("double").alias("low"), F.array().cast("array<double>").alias("lows"))
    step = lambda a, h: F.when(a["low"].isNotNull() & (h - a["low"] <= TAB_HEIGHT), a).otherwise(F.struct(h.alias("low"), F.array_append(a["lows"], h).alias("lows")))
    runs = held.groupBy("doc", "code").agg(F.aggregate(F.array_sort(F.collect_set("h")), start, step, lambda a: a["lows"]).alias("lows"))
    placed = held.join(runs, ["doc", "code"]).withColumn("run", F.array_max(F.filter("lows", lambda low: low <= F.col("h"))))
    many = placed.groupBy("doc", "code", "run").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= TAB_PAGES)
    return placed.join(many, ["doc", "code", "run"], "left_semi").select("doc", "page", "line_no")


def strip_noise(lines: DataFrame, one_in: int = 2, tails: list[tuple[str, str]] | None = None) -> DataFrame:
    """Lines without what is no text of the document (L11): those that repeat in the outer bands of half the pages (rows of an
    instruction stay), captions of the right column, tabs of languages, the rest of an address begun on the line before, and
    ``tails``: lines of a word (first pattern) after a line that ends in a call (second).  A rule of dashes at the end of a
    line goes as well."""
    known = _whole(lines)
    on_page = Window.partitionBy("doc", "page")
    before = F.trim(F.lag("text").over(on_page.orderBy("line_no")))
    t = F.trim("text")
    word = ~t.rlike(r"\s")
    address = F.coalesce(word & t.rlike(r"[/.=&?_-]") & before.rlike(r"(?i)(https?://|www\.)\S+[-/_.=&]$"), F.lit(False))
    tail = F.lit(False)
    for what, after in tails or []:
        tail = tail | F.coalesce(t.rlike(f"(?i)^(?:{what})$") & before.rlike(f"(?i)(?:{after})\\s*$"), F.lit(False))
    # Patterns that read whole lines are kept for the few that a cheaper look leaves: a rule ends in a dash or white space, a key
    # is short only if all but its digits and blanks is.
    ruled = (F.length("text") <= LONGEST) & F.substring(F.rtrim("text"), -1, 1).isin(*RULE_ENDS)
    shortened = F.when(ruled, F.regexp_replace("text", r"\s*[-–—_]{6,}\s*$", "")).otherwise(F.col("text"))
    brief = F.col("text").rlike(BRIEF)
    looked = known.withColumn("_drop", address | tail).withColumn("_brief", F.when(brief, line_key(F.col("text"))))
    short = F.coalesce(F.length("_brief") <= CAPTION_LENGTH, F.lit(False))
    mostly = F.count_if(F.col("right") & short).over(on_page) * 2 > F.count_if("right").over(on_page)
    said = F.coalesce(F.col("page").isNotNull() & F.col("right") & short & mostly & ~F.col("text").rlike(NUMBERS), F.lit(False))
    # Only a line at an edge or a short one can repeat a head or a caption, so only these have a key and are joined.
    key = F.when(short, F.col("_brief")).when(F.col("_edge"), line_key(F.col("text")))
    told = with_edge(looked).select("*", said.alias("_caption"), key.alias("_key"), F.coalesce(F.trim("text").isin(*TABS), F.lit(False)).alias("_tab"), shortened.alias("_text"))
    dropped = F.col("_drop") | ~F.coalesce(F.trim("_text") != "", F.lit(False))
    held = cut(told.select(*(F.col("_text").alias("text") if c == "text" else c for c in known.columns), dropped.alias("_drop"), "_edge", "_caption", "_key", "_tab"))
    tabs = cut(held.where("_tab"))
    keyed = held.where("NOT _drop AND NOT _tab AND _key IS NOT NULL").unionByName(tabs.where("NOT _drop").join(tab_lines(tabs), ["doc", "page", "line_no"], "left_anti").select(held.columns))
    noise = F.coalesce("_repeated", F.lit(False)) & F.col("_edge") & ~F.coalesce(row_start(F.col("text")), F.lit(False))
    kept = keyed.join(_noise_keys(held, one_in), ["doc", "_key"], "left").where(~noise & ~F.coalesce("_told", F.lit(False)))
    return kept.select(*lines.columns).unionByName(held.where("NOT _drop AND NOT _tab AND _key IS NULL").select(*lines.columns))


def _noise_keys(held: DataFrame, one_in: int) -> DataFrame:
    """doc, _key, _repeated, _told: which keys ``repeated_lines`` and ``caption_keys`` find, from lines whose pages are marked."""
    # The last line of a page is at its edge, so edge lines tell all pages.
    pages = held.where("_edge").groupBy("doc").agg(F.count_distinct("page").alias("_pages"))
    keys = held.where("_key IS NOT NULL AND (_edge OR _caption)").groupBy("doc", "_key").agg(F.count_distinct(F.when(F.col("_edge"), F.col("page"))).alias("_on"), F.count_if("_caption").alias("_n")).where((F.col("_on") >= 2) | (F.col("_n") >= CAPTION_TIMES))
    repeated = F.col("_on") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") / one_in))
    return keys.join(pages, "doc").select("doc", "_key", repeated.alias("_repeated"), (F.col("_n") >= CAPTION_TIMES).alias("_told")).where("_repeated OR _told")
