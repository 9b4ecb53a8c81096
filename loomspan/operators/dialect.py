"""Instruction text as structure: tokens of a line, titles set with blanks between their letters, nested documents (inventory
H40, L26, L36)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.steps import LONGEST, markdown_type, step_type

_TOKENS = "array<struct<type:string,text:string,values:array<string>>>"


def _key_at(text: str, i: int, by_head: dict[str, list[str]]) -> str | None:
    """The longest key that stands at ``i`` as a word of its own."""
    if i and (text[i - 1].isalnum() or text[i - 1] == "_"):
        return None
    for key in by_head.get(text[i : i + 1], ()):
        end = i + len(key)
        if text.startswith(key, i) and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
            return key
    return None


def line_tokens(text: str, counts: list[list[str]], keys: list[str]) -> list[dict]:
    """Text, counts in place of ``{{i}}`` and abbreviations of a line, in order; a placeholder without values leaves nothing."""
    by_head: dict[str, list[str]] = {}
    for key in sorted(filter(None, keys), key=len, reverse=True):
        by_head.setdefault(key[0], []).append(key)
    out, plain, i = [], [], 0

    def said() -> None:
        if plain:
            out.append({"type": "text", "text": "".join(plain), "values": None})
            plain.clear()

    while i < len(text):
        close = text.find("}}", i + 2) if text.startswith("{{", i) else -1
        if close > 0 and text[i + 2 : close].isdecimal():
            at = int(text[i + 2 : close])
            said()
            if at < len(counts) and any(v and v.strip() for v in counts[at]):
                out.append({"type": "count", "text": None, "values": counts[at]})
            i = close + 2
            continue
        key = _key_at(text, i, by_head)
        if key:
            said()
            out.append({"type": "abbr", "text": key, "values": None})
            i += len(key)
            continue
        plain.append(text[i])
        i += 1
    said()
    return out


def tokenized(lines: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """Lines (doc, t, c) with ``tokens`` (H40); ``abbreviations`` has doc and abbreviation, a document's own."""
    if abbreviations is not None:
        keys = abbreviations.where("abbreviation <> ''").groupBy("doc").agg(F.sort_array(F.collect_set("abbreviation")).alias("_keys"))
        lines = lines.join(keys, "doc", "left")
    else:
        lines = lines.withColumn("_keys", F.array().cast("array<string>"))
    schema = ", ".join(f"`{n}` {t}" for n, t in lines.drop("_keys").dtypes) + f", tokens {_TOKENS}"
    kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("values", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("t").to_pylist(), b.column("c").to_pylist(), b.column("_keys").to_pylist())
            tokens = [line_tokens(t or "", c or [], k or []) for t, c, k in rows]
            kept = b.drop_columns(["_keys"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tokens, kind)], names=[*kept.schema.names, "tokens"])

    return lines.mapInArrow(run, schema)


def letter_key(text: Column) -> Column:
    """Letters and digits alone, in capitals."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def is_letter_spaced(text: Column) -> Column:
    """Four tokens or more, at least 60 % of them one character."""
    t = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return (F.size(t) >= 4) & (F.size(F.filter(t, lambda w: F.length(w) == 1)) >= F.size(t) * 0.6)


def _words_of(text: Column, key: Column) -> Column:
    """The shortest piece of ``text`` whose letters are ``key``, null if there is none."""
    places = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(r"^[\p{L}\p{N}]$"), i + 1)), lambda i: i.isNotNull())
    at = F.instr(letter_key(text), key)
    first, last = F.try_element_at(places, at), F.try_element_at(places, at + F.length(key) - 1)
    return F.when((at > 0) & (key != ""), F.substring(text, first, last - first + 1))


def restored_titles(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """Titles (doc, title and meta, the document's own title or null) with ``restored``.

    Of a title set with blanks between its letters the words are taken from the document's own title if that holds the same
    letters, else from the first line that does and is not spaced itself, else its letters are put together.
    """
    spaced = titles.where(is_letter_spaced(F.coalesce("title", F.lit("")))).withColumn("_key", letter_key(F.col("title")))
    others = lines.where((F.length("text") <= LONGEST) & ~is_letter_spaced(F.coalesce("text", F.lit("")))).select("doc", F.struct("page", "line_no").alias("_at"), F.col("text").alias("_text"))
    # a document's titles are few, so this reads each of its lines a few times at most
    hits = spaced.select("doc", "_key").distinct().join(others, "doc").where((F.col("_key") != "") & F.contains(letter_key(F.col("_text")), F.col("_key")))
    said = hits.groupBy("doc", "_key").agg(F.min_by("_text", "_at").alias("_line"))
    found = spaced.join(said, ["doc", "_key"], "left")
    meta = F.when(F.length("meta") <= 300, _words_of(F.col("meta"), F.col("_key")))
    whole = F.coalesce(meta, _words_of(F.col("_line"), F.col("_key")), F.regexp_replace("title", r"\s+", ""))
    kept = titles.columns
    out = found.withColumn("restored", whole).select(*kept, "restored")
    return out.unionByName(titles.where(~is_letter_spaced(F.coalesce("title", F.lit("")))).withColumn("restored", F.col("title")))


def nested_documents(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """One row a Markdown document: doc, meta (names and values of its front matter), title, sections.

    A section has a title (null for what stands before the first), the kind named in brackets after the title, steps (type and
    text: note, bullet, image, table or what ``step_type`` says) and images.  Front matter is between lines of three dashes at
    the very start; the document's title is that of the front matter or else the first ``#`` line.
    """
    cut = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("pos", "line"))
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dash = F.trim("line") == "---"
    opened = F.max(F.when((F.col("pos") == 0) & dash, 1).otherwise(0)).over(order) == 1
    dashes = F.sum(dash.cast("int")).over(order)
    fenced = cut.withColumn("_front", opened & ((dashes < 2) | ((dashes == 2) & dash)))
    pair = F.split("line", ":", 2)
    front = fenced.where(F.col("_front") & F.col("line").contains(":")).groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.lower(F.trim(pair[0])).alias("key"), F.trim(pair[1]).alias("value"))))).alias("meta"))
    body = fenced.where("NOT _front").withColumn("_type", markdown_type(F.col("line"))).where("_type <> 'blank'")
    numbered = body.withColumn("section", F.sum((F.col("_type") == "section").cast("int")).over(order))
    content = F.trim(F.regexp_replace(F.trim("line"), r"^(#{1,2}|>|[-*+])\s*", ""))
    image = F.regexp_extract(F.trim("line"), r"^!\[[^\]]*\]\(([^)]+)\)$", 1)
    kind = F.when(F.col("_type").isin("note", "bullet", "table"), F.col("_type")).otherwise(step_type(content))
    told = numbered.withColumn("t", content).withColumn("kind", kind).withColumn("image", F.nullif(image, F.lit("")))
    listed = lambda c, s: F.transform(F.sort_array(F.collect_list(F.when(c, s))), lambda x: x["s"])
    head = F.max(F.when(F.col("_type") == "section", F.col("t")))
    per = told.groupBy("doc", "section").agg(
        head.alias("head"), F.min(F.when(F.col("_type") == "title", F.struct("pos", "t")))["t"].alias("title"),
        listed(~F.col("_type").isin("section", "title", "image"), F.struct("pos", F.struct(F.col("kind").alias("type"), "t").alias("s"))).alias("steps"),
        listed(F.col("_type") == "image", F.struct("pos", F.col("image").alias("s"))).alias("images"),
    )
    name = F.trim(F.regexp_replace("head", r"\s*\[[^\]]*\]\s*$", ""))
    marked = per.withColumn("kind", F.nullif(F.regexp_extract("head", r"\[([^\]]*)\]\s*$", 1), F.lit("")))
    some = marked.where((F.size("steps") > 0) | (F.size("images") > 0) | F.col("head").isNotNull())
    sections = some.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("section", name.alias("title"), "kind", "steps", "images"))).alias("sections"))
    first = marked.where("title IS NOT NULL").groupBy("doc").agg(F.min_by("title", "section").alias("title"))
    out = docs.select(F.col(doc).alias("doc")).join(front, "doc", "left").join(first, "doc", "left").join(sections, "doc", "left")
    own = F.coalesce(F.try_element_at(F.col("meta"), F.lit("title")), F.col("title"))
    return out.select("doc", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"), own.alias("title"), F.coalesce("sections", F.array().cast(dict(sections.dtypes)["sections"])).alias("sections"))
