"""Text keys and labels: accent folding, slugs, header names, CSV cells (inventory A17-A19, A26, H24-H37)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their plain letters, from the Unicode decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_MARKED, _PLAIN = _accents()


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, however often it is used."""
    return F.transform(F.array(x), use)[0]


def fold(x: Column) -> Column:
    """Lower case, marks removed, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), _MARKED, _PLAIN), r"\p{M}+", ""))


def header_key(x: Column) -> Column:
    """Fold; runs of ``_``, ``-`` and blanks become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(x), "[_-]+", " "), r"\s+", " "))


def slug(x: Column, longest: int = 60) -> Column:
    """Fold; everything but letters and digits becomes one dash, none at the ends."""
    dashed = F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, longest), "-+$", "")


def joined_key(*parts: Column) -> Column:
    """Folded parts joined by ``|``; a missing part is empty."""
    return F.concat_ws("|", *(F.coalesce(fold(p), F.lit("")) for p in parts))


def label(*parts: Column, between: str = " · ") -> Column:
    """Parts that are not blank, joined."""
    return F.concat_ws(between, *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def csv_cell(x: Column, is_text: bool = True) -> Column:
    """A cell for a ``;`` separated file: text that starts like a formula gets a quote mark before it, cells that hold
    ``"``, ``;`` or a line break are quoted (A26)."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    if is_text:
        text = F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike('[";\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def content_id(x: Column) -> Column:
    """Eight hexadecimal digits that name a content."""
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 8)


def trailing_id(x: Column) -> Column:
    """The number in brackets at the end of a folder name, or null."""
    return F.nullif(F.regexp_extract(x, r"\[(\d+)\]\s*$", 1), F.lit("")).try_cast("long")


def lines(x: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")


def distinct_trimmed(xs: Column) -> Column:
    """Ordered distinct of trimmed elements that are not blank."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != ""))


def first_keyword(x: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """Label of the first keyword that the folded text holds."""
    key = fold(x)
    out = None
    for word, name in rules:
        out = F.when(key.contains(word), name) if out is None else out.when(key.contains(word), name)
    return out.otherwise(F.lit(other))


def expand_counts(template: Column, counts: Column, size: Column) -> Column:
    """``{{i}}`` placeholders of a step replaced by the count for the chosen size."""
    filled = F.transform(counts, lambda c: F.coalesce(F.try_element_at(c, (size + 1).cast("int")), F.lit("")))
    indexed = F.transform(filled, lambda v, i: F.struct(F.concat(F.lit("{{"), i.cast("string"), F.lit("}}")).alias("k"), v.alias("v")))
    return F.aggregate(indexed, template, lambda acc, p: F.replace(acc, p["k"], p["v"]))


def fold_eszett(x: Column) -> Column:
    """Capital sharp s to the small one, for comparison only."""
    return F.replace(x, F.lit("\u1e9e"), F.lit("\u00df"))


def canonical_name(raw: Column, catalogue: list[str]) -> Column:
    """The catalogue's spelling of a name that differs from it in case only; other names stay, trimmed."""
    name = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, catalogue)), lambda n: F.lower(n) == F.lower(name)), F.lit(1)), name)
