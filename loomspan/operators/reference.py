"""What a document says about itself: size labels, its reference block, how many patterns it holds, chart cells
(inventory L8, L22, L24, L48).

Line rows have ``doc``, ``page``, ``line_no`` and ``text``.  Everything is an aggregation or a window a document; a line is told by
its tokens and its measures, numbers with a unit; only lines of up to ``steps.LONGEST`` characters are looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.numbers import measures
from loomspan.operators.steps import LONGEST, glossary, size_vectors

# Words are parameters; these are the usual ones of the languages that documents are in.
SIZE_WORDS = ("size", "sizes", "taille", "tailles", "größe", "größen", "talla", "tallas", "taglia", "taglie", "maat", "maten", "størrelse", "størrelser", "storlek", "storlekar")
AGE_WORDS = ("year", "years", "yrs", "month", "months", "mos", "an", "ans", "mois", "jahr", "jahre", "monat", "monate", "año", "años", "mes", "meses")
LEAST_SIZES, MOST_SIZES = 2, 12
#: Letters of sizes: small and large with up to three X, or counted ones up to six; medium; one size for all.
LETTER_SIZES = ("M", *("X" * n + base for n in range(4) for base in "SL"), *(f"{n}X{base}" for n in range(2, 7) for base in "SL"))
ONE_SIZE = ("ONESIZE", "OS", "UNIQUE")


class Words(NamedTuple):
    """What reference lines are recognised by: words, units of length and weight, and labels that open a block of their field."""

    stitches: tuple[str, ...] = ("stitch", "stitches", "st", "sts", "maille", "mailles", "m", "masche", "maschen", "punto", "puntos")
    needles: tuple[str, ...] = ("needle", "needles", "hook", "hooks", "aiguille", "aiguilles", "crochet", "crochets", "nadel", "nadeln", "häkelnadel", "aguja", "agujas", "ganchillo")
    fibres: tuple[str, ...] = ("yarn", "wool", "cotton", "mohair", "alpaca", "merino", "fil", "laine", "coton", "alpaga", "garn", "wolle", "baumwolle", "lana", "algodón")
    swatches: tuple[tuple[float, str], ...] = ((10.0, "cm"), (4.0, "in"), (4.0, "inches"), (4.0, "\""))
    widths: tuple[str, ...] = ("mm",)
    amounts: tuple[str, ...] = ("g", "gr", "m", "yd", "yds", "yard", "yards", "ball", "balls", "skein", "skeins", "pelote", "pelotes", "knäuel", "ovillo", "ovillos")
    labels: tuple[tuple[str, str], ...] = (
        ("gauge", "gauge"), ("tension", "gauge"), ("échantillon", "gauge"), ("maschenprobe", "gauge"), ("muestra", "gauge"),
        ("needles", "needles"), ("hook", "needles"), ("aiguilles", "needles"), ("nadeln", "needles"), ("agujas", "needles"),
        ("yarn", "yarns"), ("materials", "yarns"), ("laine", "yarns"), ("fournitures", "yarns"), ("garn", "yarns"), ("material", "yarns"), ("lana", "yarns"), ("materiales", "yarns"),
    )


#: Lines that a label's block may have besides its own.
BLOCK_LINES = 4


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _one_of(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def is_size(token: Column, numbers: bool) -> Column:
    """Whether a token in capitals is a size: letters, two of them with a slash, one size for all, or (if asked) a number or an age range."""
    letters = F.forall(F.split(token, "/"), lambda t: t.isin(*LETTER_SIZES)) & (F.size(F.split(token, "/")) <= 2)
    out = letters | token.isin(*ONE_SIZE)
    return out | F.forall(F.split(token, "[-/]"), lambda t: (F.length(t) <= 3) & t.try_cast("int").isNotNull()) if numbers else out


def size_list(text: Column, numbers: bool = False, ages: tuple[str, ...] = AGE_WORDS) -> Column:
    """The sizes of a line that names nothing else, 2 to 12 of them, else null; units of length and age are left out."""
    plain = F.replace(F.upper(F.translate(text, "()[],;:–", "        ")), F.lit("ONE SIZE"), F.lit("ONESIZE"))
    units = tuple(w.upper() for w in ("cm", "mm", "in", *ages))
    found = F.filter(F.split(plain, r"\s+"), lambda t: (t != "") & (t != "-") & ~t.isin(*units))
    fits = F.size(found).between(LEAST_SIZES, MOST_SIZES) & F.forall(found, lambda t: is_size(t, numbers))
    return F.when((F.length(text) <= LONGEST) & fits, found)


def size_labels(lines: DataFrame, words: tuple[str, ...] = SIZE_WORDS, vectors: Column | None = None) -> DataFrame:
    """doc, labels and where they come from, for every document.

    The first source that says something counts: a line that starts with a size word, its list on the same line or, where the
    word stands alone, on the next, and where the list ends in a comma or an open bracket, on the line after it as well
    (``line``); a line of sizes only (``header``); sizes that start lines before a colon, two different ones twice each
    (``prefix``); the most frequent length of size vectors if it occurs three times, the longer of equals, as T1, T2, ...
    (``modal``); else no labels (``none``).  ``vectors`` gives a line's vectors, by default those of the short form.
    """
    text, place, order = F.trim("text"), F.struct("page", "line_no"), Window.partitionBy("doc").orderBy("page", "line_no")
    ahead = [F.coalesce(F.trim(F.lead("text", n).over(order)), F.lit("")) for n in (1, 2)]
    head = F.lower(F.substring_index(F.regexp_replace(text, "[:-]", " "), " ", 1))
    named = F.col("_head").isin(*words)
    rest = F.trim(F.regexp_replace(F.substring(text, F.length("_head") + 1, LONGEST + 1), r"^\s*[:-]?", ""))
    wraps = lambda c: c.rlike(r"[,(]\s*$") | (F.length(F.regexp_replace(c, "[^(]", "")) > F.length(F.regexp_replace(c, "[^)]", "")))
    whole = F.when(F.col("_rest") != "", F.when(wraps(F.col("_rest")), F.concat_ws(" ", "_rest", "_next")).otherwise(F.col("_rest"))).otherwise(F.when(wraps(F.col("_next")), F.concat_ws(" ", "_next", "_after")).otherwise(F.col("_next")))
    shown = lines.withColumn("_next", ahead[0]).withColumn("_after", ahead[1]).withColumn("_head", head).withColumn("_rest", rest)
    prefix = F.upper(F.trim(F.substring_index(text, ":", 1)))
    bare = F.when(F.lower(F.substring_index(prefix, " ", 1)).isin(*words), F.trim(F.substring(prefix, F.length(F.substring_index(prefix, " ", 1)) + 1, 20))).otherwise(prefix)
    marked = shown.select(
        "doc", place.alias("at"), size_list(F.when(named, whole), True).alias("line"), size_list(text).alias("header"),
        F.when(text.contains(":") & (F.length(bare) <= 12) & is_size(F.replace(bare, F.lit("ONE SIZE"), F.lit("ONESIZE")), False), bare).alias("prefix"), (size_vectors(F.col("text")) if vectors is None else vectors).alias("vectors"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    said = marked.groupBy("doc").agg(first("line").alias("line"), first("header").alias("header"))
    twice = marked.where("prefix IS NOT NULL").groupBy("doc", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where("n >= 2")
    twice = twice.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "prefix"))), lambda s: s["prefix"]).alias("prefixes")).where("size(prefixes) >= 2")
    lengths = marked.select("doc", F.explode("vectors").alias("v")).groupBy("doc", F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    modal = lengths.groupBy("doc").agg(F.max(F.struct("n", "size")).alias("m")).where("m.n >= 3")
    numbered = F.transform(F.sequence(F.lit(1), F.col("m.size")), lambda i: F.concat(F.lit("T"), i.cast("string")))
    source = F.when(F.col("line").isNotNull(), "line").when(F.col("header").isNotNull(), "header").when(F.col("prefixes").isNotNull(), "prefix").when(F.col("m").isNotNull(), "modal").otherwise("none")
    labels = F.coalesce("line", "header", "prefixes", F.when(F.col("m").isNotNull(), numbered), F.array().cast("array<string>"))
    return said.join(twice, "doc", "left").join(modal, "doc", "left").select("doc", labels.alias("labels"), source.alias("source"))


def reference_lines(lines: DataFrame, words: Words = Words()) -> DataFrame:
    """Lines with ``field``: gauge, needles, yarns or abbreviation, and the parts of an abbreviation.

    A line that begins with a label and a colon opens a block: its value, and up to four lines that follow without a label, a
    colon or the end of a sentence before them, belong to the label's field.  Outside of blocks a line is told by its words
    and measures: stitches over a swatch, needles with a width or a US number, fibres with an amount; the first that fits.
    """
    short, text, order = F.length("text") <= LONGEST, F.trim("text"), Window.partitionBy("doc").orderBy("page", "line_no")
    has = lambda some: F.arrays_overlap(F.col("_tokens"), _one_of(some))
    unit = lambda some: F.exists("_measures", lambda m: m["unit"].isin(*some)) if some else F.lit(False)
    swatch = F.exists("_measures", lambda m: reduce(or_, [(m["value"] == v) & (m["unit"] == u) for v, u in words.swatches], F.lit(False)))
    us = F.exists(F.arrays_zip(F.col("_tokens").alias("a"), F.slice("_tokens", 2, F.greatest(F.size("_tokens"), F.lit(1))).alias("b")), lambda p: (p["a"] == "us") & p["b"].try_cast("int").isNotNull())
    told = F.when(has(words.stitches) & swatch, "gauge").when(has(words.needles) & (unit(words.widths) | us), "needles").when(has(words.fibres) & unit(words.amounts), "yarns")
    label = F.lower(F.trim(F.substring_index(text, ":", 1)))
    fields = F.create_map(*(F.lit(x) for pair in words.labels for x in pair)) if words.labels else F.create_map().cast("map<string,string>")
    named = F.when(short & text.contains(":"), F.try_element_at(fields, label))
    known = lines.withColumn("_tokens", F.when(short, tokens(text))).withColumn("_measures", F.when(short, measures(text))).withColumn("_label", named)
    before = F.coalesce(F.trim(F.lag("text").over(order)), F.lit(""))
    # a block goes on until a colon, or the line after a sentence has ended; other fields' lines do not belong to it
    stops = F.col("_label").isNotNull() | text.contains(":") | (before.rlike(r"[.!?]$"))
    blocks = known.withColumn("_block", F.sum(stops.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_told", told)
    within = Window.partitionBy("doc", "_block").orderBy("page", "line_no")
    opened = blocks.withColumn("_open", F.first("_label").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(within))
    field = F.when(F.col("_open").isNotNull() & (F.col("_nth") <= BLOCK_LINES + 1) & short, F.col("_open")).otherwise(F.col("_told"))
    value = F.when(F.col("_label").isNotNull(), F.trim(F.substring(text, F.length(F.substring_index(text, ":", 1)) + 2, LONGEST))).otherwise(F.col("text"))
    rest = opened.withColumn("field", field).withColumn("_value", value)
    found = rest.where("field IS NOT NULL AND _value <> ''").select("doc", "page", "line_no", F.col("_value").alias("text"), "field", F.lit(None).cast("string").alias("abbreviation"), F.lit(None).cast("string").alias("meaning"))
    words_ = glossary(rest.where("field IS NULL")).withColumn("field", F.lit("abbreviation"))
    return found.unionByName(words_.select("doc", "page", "line_no", "text", "field", "abbreviation", "meaning"))


def reference_block(lines: DataFrame, words: Words = Words()) -> DataFrame:
    """gauge (the lines of the first one: its block, or the one line), needles and yarns (distinct lines in order), abbreviations (the
    first meaning of each) and notes (lines that give another meaning), for every document that has any (L24)."""
    found = reference_lines(lines, words).withColumn("at", F.struct("page", "line_no"))
    texts = found.where("field <> 'abbreviation'").groupBy("doc", "field", "text").agg(F.min("at").alias("at"))
    of = lambda name: F.when(F.col("field") == name, F.struct("at", "text"))
    listed = lambda name: F.transform(F.sort_array(F.collect_list(of(name))), lambda s: s["text"]).alias(name)
    # lines of the first gauge stand one under the other
    gauge = lambda s: F.array_join(F.transform(F.filter(s, lambda x, i: (x["at"]["page"] == s[0]["at"]["page"]) & (x["at"]["line_no"] == s[0]["at"]["line_no"] + i)), lambda x: x["text"]), " ")
    block = texts.groupBy("doc").agg(F.sort_array(F.collect_list(of("gauge"))).alias("g"), listed("needles"), listed("yarns")).withColumn("gauge", F.when(F.size("g") > 0, gauge(F.col("g"))))
    entries = found.where("field = 'abbreviation'")
    same = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    first = entries.groupBy("doc", "abbreviation").agg(F.min(F.struct("at", "meaning")).alias("f"))
    glossary_ = first.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("f.at", "abbreviation", "f.meaning"))), lambda s: F.concat(s["abbreviation"], F.lit(" = "), s["meaning"])).alias("abbreviations"))
    other = entries.join(first, ["doc", "abbreviation"]).where(same(F.col("meaning")) != same(F.col("f.meaning")))
    notes = other.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]).alias("notes"))
    none = F.array().cast("array<string>")
    out = block.join(glossary_, "doc", "full").join(notes, "doc", "left")
    return out.select("doc", F.coalesce("gauge", F.lit("")).alias("gauge"), *(F.coalesce(c, none).alias(c) for c in ("needles", "yarns", "abbreviations", "notes")))


#: A heading is real with two supply lines among the next eight; a pattern has two rows at least; a title is set 1.4 times as
#: large as the median line; a book has four pages and three patterns (fixed values).
REACH, LEAST_SUPPLIES, LEAST_ROWS, TITLE_RATIO, BOOK_PAGES, BOOK_PATTERNS = 8, 2, 2, 1.4, 4, 3


def several_patterns(lines: DataFrame, heading: Column, language: Column, supply: Column, row: Column, sizes: Column) -> DataFrame:
    """Patterns of each document, and whether it is a book of several (L8).  ``lines`` has ``size``, the height of its type.

    The first real heading of supplies starts a pattern.  Each later one does if, since the real heading before it, a new
    large title or another size list was read and two rows at least, and it is in a language that headings had before
    (else it is the translation).  Conditions say which lines are headings, in which language, supplies, numbered rows, and
    what a line's size list is (null for none).
    """
    order = Window.partitionBy("doc").orderBy("page", "line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    next_lines = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(1, REACH)
    last_lines = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(-REACH, -1)
    flag = lambda c: F.coalesce(c, F.lit(False))
    # supplies count up to the next heading only
    stop = Window.partitionBy("doc", "page", "_block").orderBy("line_no").rowsBetween(1, REACH)
    marked = lines.withColumn("_heading", flag(heading)).withColumn("_block", F.sum(F.col("_heading").cast("int")).over(up_to))
    real = F.col("_heading") & (F.coalesce(F.sum(flag(supply).cast("int")).over(stop), F.lit(0)) >= LEAST_SUPPLIES)
    marked = marked.withColumn("_real", real).withColumn("_sizes", F.when(~F.col("_heading"), sizes)).withColumn("_k", F.sum(F.col("_real").cast("int")).over(up_to))
    median = F.try_element_at(F.sort_array(F.collect_list("size")), (F.floor(F.count("size") / 2) + 1).cast("int"))
    heights = lines.where("size > 0").groupBy("doc").agg(median.alias("_median"))
    text = F.trim("text")
    near = flag(F.max(F.col("_real")).over(last_lines))
    title = ~F.col("_heading") & F.col("_sizes").isNull() & ~near & (F.col("size") >= TITLE_RATIO * F.col("_median")) & F.length(text).between(3, 80)
    marked = marked.join(heights, "doc", "left").withColumn("_title", F.when(flag(title), F.lower(text)))
    new_title = F.col("_title").isNotNull() & (F.row_number().over(Window.partitionBy("doc", "_title").orderBy("page", "line_no")) == 1)
    last = F.last("_sizes", ignorenulls=True).over(before)
    changed = flag(F.col("_sizes").isNotNull() & last.isNotNull() & (F.col("_sizes") != last))
    marked = marked.withColumn("_arms", (new_title | changed) & (F.col("_k") > 0)).withColumn("_row", flag(row) & ~F.col("_heading")).withColumn("_language", F.when(F.col("_real"), language))
    per = marked.groupBy("doc", "_k").agg(F.max("_arms").alias("armed"), F.count_if("_row").alias("rows"), F.max("_language").alias("language"))
    ahead = Window.partitionBy("doc").orderBy("_k")
    known = F.row_number().over(Window.partitionBy("doc", "language").orderBy("_k")) > 1
    real_ones = per.withColumn("armed", F.lag("armed").over(ahead)).withColumn("rows", F.lag("rows").over(ahead)).where("_k > 0")
    counted = real_ones.withColumn("counted", (F.col("_k") == 1) | (flag(F.col("armed")) & (F.col("rows") >= LEAST_ROWS) & known))
    totals = counted.groupBy("doc").agg(F.count_if("counted").alias("patterns"))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    patterns = F.coalesce("patterns", F.lit(0)).cast("long")
    return pages.join(totals, "doc", "left").select("doc", "pages", patterns.alias("patterns"), ((F.col("pages") >= BOOK_PAGES) & (patterns >= BOOK_PATTERNS)).alias("several"))


#: Glyphs and long runs that make a chart, the gap between its rows in median gaps, and the margin of its outline (fixed values).
CHART_GLYPHS, CHART_RUNS, CHART_GAP, CHART_PAD = 40, 5, 4, 2


def chart_cells(cells: DataFrame) -> DataFrame:
    """Cells (doc, page, cell, x, end_x, y, text) that belong to a chart: runs of one symbol in dense rows, and what their outline
    holds (L48).  Rows of a symbol are one chart as long as no gap is over four times the median gap."""
    # all tokens equal, one symbol, no digit
    parts = F.split(F.trim("text"), r"\s+")
    symbol = F.when((F.size(F.array_distinct(parts)) == 1) & (F.length(parts[0]) == 1) & ~parts[0].rlike(r"\p{N}"), parts[0])
    glyphs = cells.withColumn("glyph", symbol).where("glyph IS NOT NULL").withColumn("count", F.size(parts))
    key = ["doc", "page", "glyph"]
    rows = glyphs.select(*key, "y").distinct()
    down = Window.partitionBy(*key).orderBy(F.desc("y"))
    rows = rows.withColumn("gap", F.lag("y").over(down) - F.col("y"))
    usual = rows.where("gap IS NOT NULL").groupBy(*key).agg(F.percentile("gap", F.lit(0.5)).alias("usual"))
    parted = rows.join(usual, key, "left").withColumn("part", F.sum(F.coalesce((F.col("gap") > CHART_GAP * F.col("usual")).cast("int"), F.lit(0))).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    placed = glyphs.join(parted.select(*key, "y", "part"), [*key, "y"])
    dense = placed.groupBy(*key, "part").agg(
        F.sum("count").alias("n"), F.count_if(F.col("count") >= 3).alias("long"), F.min("x").alias("x0"), F.max("end_x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).where((F.col("n") >= CHART_GLYPHS) & (F.col("long") >= CHART_RUNS))
    own = placed.join(dense.select(*key, "part"), [*key, "part"], "left_semi").select(*cells.columns)
    c, d = cells.alias("c"), dense.alias("d")
    inside = (F.col("c.x") >= F.col("d.x0") - CHART_PAD) & (F.col("c.end_x") <= F.col("d.x1") + CHART_PAD) & (F.col("c.y") > F.col("d.y0")) & (F.col("c.y") < F.col("d.y1"))
    held = c.join(d, (F.col("c.doc") == F.col("d.doc")) & (F.col("c.page") == F.col("d.page")) & inside, "left_semi")
    return own.unionByName(held).distinct()
