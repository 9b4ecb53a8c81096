"""Instruction lines: size vectors, placeholders, step types, Markdown lines (inventory H39, H40, H41, L14, L18,
L20, L21, L23, L25, L26, L28, L29, L36, L37, L38, L39, L40, L44, L46, L50, L51)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest line the patterns below look at.
LONGEST = 4000
_NUMBER = r"\d+(?:[.,]\d+)?"
#: 80 (90, 100) 110: a number, a bracketed group, and possibly more numbers or groups.
VECTOR = rf"{_NUMBER}\s*(?:[(\[]\s*{_NUMBER}(?:\s*[,:/-]\s*{_NUMBER}|\s+{_NUMBER})*\s*[)\]]\s*)+(?:{_NUMBER})?|{_NUMBER}(?:\s*/\s*{_NUMBER}){{2,}}"
ROW = r"(?i)^(rows?|rnds?|rounds?|rangs?|tours?|reihen?|runden?|vueltas?|hileras?)\s*\d+"
REPEAT = r"(?i)\b(repeat|répéter|répétez|wiederholen|repetir)\b.*?(\d+)\s*(?:x|times|fois|mal|veces)"
NOTE = r"(?i)^(notes?|nb|remarques?|hinweis|nota)\s*:"


def size_vectors(line: Column) -> Column:
    """Size vectors of a line as arrays of numbers, two sizes at least."""
    found = F.when(F.length(line) <= LONGEST, F.regexp_extract_all(line, F.lit(f"({VECTOR})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda v: F.regexp_extract_all(v, F.lit(f"({_NUMBER})"), F.lit(1))), lambda v: F.size(v) >= 2)


def with_placeholders(lines: DataFrame, sizes: int) -> DataFrame:
    """``t``: the line with each vector of exactly ``sizes`` numbers as ``{{i}}``; ``c``: those vectors."""
    text = F.col("text")
    raw = F.when(F.length(text) <= LONGEST, F.regexp_extract_all(text, F.lit(f"({VECTOR})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    numbers = lambda v: F.regexp_extract_all(v, F.lit(f"({_NUMBER})"), F.lit(1))
    fitting = F.filter(F.transform(raw, lambda v: F.rtrim(v)), lambda v: F.size(numbers(v)) == sizes)
    out = lines.withColumn("_v", fitting)

    indexed = F.transform("_v", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    start = F.struct(F.lit("").alias("done"), text.alias("rest"))
    step = lambda a, p: F.struct(
        F.concat(a["done"], F.call_function("substring_index", a["rest"], p["v"], F.lit(1)), F.lit("{{"), p["i"].cast("string"), F.lit("}}")).alias("done"),
        F.call_function("substr", a["rest"], F.length(F.call_function("substring_index", a["rest"], p["v"], F.lit(1))) + F.length(p["v"]) + 1).alias("rest"),
    )
    walked = F.aggregate(indexed, start, step, lambda a: F.concat(a["done"], a["rest"]))
    return out.withColumn("t", walked).withColumn("c", F.transform("_v", numbers)).drop("_v")


def step_type(line: Column) -> Column:
    """row, repeat, note or text; lines that are too long are text."""
    short = F.length(line) <= LONGEST
    return F.when(short & line.rlike(NOTE), "note").when(short & line.rlike(REPEAT), "repeat").when(short & line.rlike(ROW), "row").otherwise("text")


def repeat_count(line: Column) -> Column:
    return F.when(F.length(line) <= LONGEST, F.nullif(F.regexp_extract(line, REPEAT, 2), F.lit("")).try_cast("int"))


def table_row(line: Column, least: int = 3) -> Column:
    """At least three numbers and little else."""
    numbers = F.size(F.regexp_extract_all(line, F.lit(f"({_NUMBER})"), F.lit(1)))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return F.when(F.length(line) <= LONGEST, (numbers >= least) & (letters <= numbers * 4)).otherwise(F.lit(False))


def author(line: Column) -> Column:
    """Name after "by", "par", "von" or "de" in a designer line."""
    found = F.regexp_extract(line, r"^(?i:(?:(?:design(?:ed)?|pattern|patron|modèle|entwurf|diseño)\s+)?(?:by|par|von|de)\s*:?\s+)(\p{Lu}[\p{L}.'-]+(?:\s+\p{Lu}[\p{L}.'-]+){0,3})\s*$", 1)
    return F.nullif(found, F.lit(""))


def despaced(title: Column) -> Column:
    """Letter-spaced titles glued: four tokens or more, at least 60 % of one letter."""
    t = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    spaced = (F.size(t) >= 4) & (F.size(F.filter(t, lambda w: F.length(w) == 1)) >= F.size(t) * 0.6)
    return F.when(spaced, F.array_join(F.transform(F.split(title, r"\s{2,}"), lambda w: F.regexp_replace(w, r"\s+", "")), " ")).otherwise(title)


def document_title(lines: DataFrame, most_chars: int = 80) -> DataFrame:
    """The largest short line of the first page, the first of equals (L18).  ``lines`` has ``size``."""
    first = lines.where((F.col("page") == 0) & (F.length("text").between(3, most_chars)) & F.col("text").rlike(r"\p{L}{2}"))
    return first.groupBy("doc").agg(F.max_by("text", F.struct("size", -F.col("line_no"))).alias("title"))


def paper_notation(values: Column) -> Column:
    """80 (90, 100): the first number and the others in brackets."""
    return F.when(F.size(values) <= 1, F.array_join(values, "")).otherwise(F.concat(values[0], F.lit(" ("), F.array_join(F.slice(values, 2, F.size(values) - 1), ", "), F.lit(")")))


def markdown_type(line: Column) -> Column:
    """section, title, note, bullet, table, image, blank or text."""
    t = F.trim(line)
    return (
        F.when(t == "", "blank").when(t.rlike(r"^##\s+\S"), "section").when(t.rlike(r"^#\s+\S"), "title").when(t.rlike(r"^>\s?"), "note")
        .when(t.rlike(r"^[-*+]\s+\S"), "bullet").when(t.rlike(r"^\|.*\|$"), "table").when(t.rlike(r"^!\[[^\]]*\]\([^)]+\)$"), "image").otherwise("text")
    )


def parse_markdown(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Lines of Markdown documents with type, section number and title, and content without its mark."""
    cut = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("pos", "line"))
    typed = cut.withColumn("type", markdown_type(F.col("line"))).where("type <> 'blank'")
    so_far = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    content = F.trim(F.regexp_replace(F.trim("line"), r"^(#{1,2}|>|[-*+])\s*", ""))
    numbered = typed.withColumn("content", content).withColumn("section", F.sum((F.col("type") == "section").cast("int")).over(so_far))
    return numbered.withColumn("title", F.last(F.when(F.col("type") == "section", F.col("content")), ignorenulls=True).over(so_far)).drop("line")


def write_markdown(parsed: DataFrame) -> DataFrame:
    """The inverse of parse_markdown up to blank lines: one text a document."""
    mark = F.when(F.col("type") == "section", "## ").when(F.col("type") == "title", "# ").when(F.col("type") == "note", "> ").when(F.col("type") == "bullet", "- ").otherwise("")
    lines = F.sort_array(F.collect_list(F.struct("pos", F.concat(mark, F.col("content")).alias("line"))))
    return parsed.groupBy("doc").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("text"))


def reader_faults(sections: DataFrame) -> DataFrame:
    """Structural faults of nested documents: missing ids, unknown kinds, steps without text."""
    checks = F.array(
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no_id"), F.when(F.coalesce(F.trim("kind"), F.lit("")) == "", "no_kind"),
        F.when(F.exists(F.coalesce("steps", F.array().cast("array<struct<t:string>>")), lambda s: F.coalesce(F.trim(s["t"]), F.lit("")) == ""), "empty_step"),
    )
    return sections.withColumn("faults", F.array_compact(checks))


def lexicon_hit(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, whole and in any case."""
    return text.rlike(r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(words) + r")(?![\p{L}\p{N}])")


def row_start(line: Column) -> Column:
    """Whether a line starts a numbered row; such lines are never taken for running heads."""
    return F.when(F.length(line) <= LONGEST, line.rlike(ROW)).otherwise(F.lit(False))


def glossary(lines: DataFrame) -> DataFrame:
    """Abbreviation and meaning from "k2tog = knit two together", "k: knit" or columns two blanks apart."""
    pattern = r"^\s*([\p{L}0-9][\p{L}0-9./-]{0,11})\s*(?:=|:|\s{2,}|–)\s*(\p{L}.{2,})$"
    short = F.when(F.length("text") <= LONGEST, F.regexp_extract("text", pattern, 1)).otherwise("")
    out = lines.withColumn("abbreviation", short).withColumn("meaning", F.trim(F.regexp_extract("text", pattern, 2)))
    return out.where("abbreviation <> '' AND meaning <> ''")


def first_hint(lines: DataFrame, pattern: str, priority: list[str]) -> DataFrame:
    """First line that matches, sections in their order of priority (L29).  ``lines`` has ``kind``."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("kind")), F.lit(0).cast("long")), F.lit(len(priority) + 1).cast("long"))
    hit = lines.where((F.length("text") <= LONGEST) & F.col("text").rlike(pattern))
    return hit.groupBy("doc").agg(F.min_by("text", F.struct(place, "page", "line_no")).alias("hint"))


def to_reader(sections: DataFrame) -> DataFrame:
    """Sections of plain text to nested steps, one a line that is not blank."""
    from loomspan.functions.text import lines as cut

    steps = F.transform(cut(F.col("instructions")), lambda t: F.struct(t.alias("t"), step_type(t).alias("type")))
    return sections.select("doc", "id", "kind", "title", steps.alias("steps"))
