"""Numbers as people type them: decimal commas, blanks, two-decimal rounding, units (inventory H1-H23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import once

#: Metres in a yard, grams in an ounce, ounces in a pound.
METRES_PER_YARD, GRAMS_PER_OUNCE, OUNCES_PER_POUND = 0.9144, 28.349523125, 16
#: Whole numbers below this are the same as a double with two decimals.
EXACT = 10**15
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_decimal(raw: Column) -> Column:
    """The first comma becomes a dot; blank is 0; anything unreadable is null (H1)."""
    typed = raw.cast("string")
    comma = F.instr(typed, ",")
    text = F.trim(F.when(comma > 0, F.overlay(typed, F.lit("."), comma, 1)).otherwise(typed))
    return once(text, lambda t: F.when(t == "", F.lit(0.0)).when(t.rlike(_NUMBER), t.try_cast("double")))


def is_readable(raw: Column) -> Column:
    """Whether parse_decimal gives a finite number (H2); null is not readable."""
    return F.coalesce(parse_decimal(raw).isNotNull(), F.lit(False))


def has_value(raw: Column) -> Column:
    """Noted at all: not blank after trimming; "0" counts."""
    return F.coalesce(F.length(F.trim(raw.cast("string"))) > 0, F.lit(False))


def to_number(raw: Column) -> Column:
    """Import cell to number: blanks and no-break spaces go, comma is a dot, anything else is null (H5)."""
    text = F.regexp_replace(F.regexp_replace(raw.cast("string"), r"[\s  ]", ""), ",", ".")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def measures(text: Column) -> Column:
    """Numbers that a unit follows, as an array of value and unit (lower case; a quotation mark counts as one)."""
    pattern = F.lit(r"([0-9]+(?:[.,][0-9]+)?)\s*([\p{L}]+|\")")
    value, unit = (F.regexp_extract_all(F.lower(text), pattern, F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(value.alias("v"), unit.alias("u")), lambda m: F.struct(F.replace(m["v"], F.lit(","), F.lit(".")).cast("double").alias("value"), m["u"].alias("unit")))


def round2(x: Column) -> Column:
    """Half-up on the binary value times 100; not the same as ROUND for 1.005 (H6, H7)."""
    return F.floor(x * 100 + 0.5).cast("double") / 100


def hundredths(x: Column) -> Column:
    """Integer join key for sizes that agree to a hundredth (H8)."""
    return F.floor(x * 100 + 0.5).cast("int")


def keep_decimal_characters(raw: Column) -> Column:
    """Digits and the first separator of a typed number (H3)."""

    def first_only(kept: Column) -> Column:
        first = F.instr(F.translate(kept, ",", "."), ".")
        return F.when(first > 0, F.concat(F.substring(kept, F.lit(1), first), F.translate(F.substring(kept, first + 1, F.length(kept)), ".,", ""))).otherwise(kept)

    return once(F.regexp_replace(raw, r"[^0-9.,]", ""), first_only)


def with_decimal_mark(raw: Column, mark: str = ",") -> Column:
    """A plain number with another decimal mark, digits untouched; other text passes through (H4)."""
    marked = F.translate(F.trim(raw), ".,", mark * 2) if len(mark) == 1 else F.regexp_replace(F.trim(raw), "[.,]", mark)
    return F.when(F.trim(raw).rlike(r"^-?\d+([.,]\d+)?$"), marked).otherwise(raw)


def amount_text(x: Column) -> Column:
    """No decimals for whole amounts, two otherwise."""
    r = round2(x)

    def told(cents: Column) -> Column:
        """Put together from whole cents, which a format pattern takes several times as long for."""
        whole = F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(F.abs(cents) / 100).cast("string"))
        return F.when(cents % 100 == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")))

    plain = F.when(r == F.floor(r), F.format_string("%.0f", r)).otherwise(F.format_string("%.2f", r))
    return F.when(F.abs(r) < EXACT / 100, once(F.floor(x * 100 + 0.5), told)).otherwise(plain)


def length_text(metres: Column, system: str = "metric") -> Column:
    """Metres or kilometres from 1000 on; yards in the imperial system (H9)."""
    if system == "imperial":
        yards = F.floor(metres / METRES_PER_YARD + 0.5)
        return F.concat(F.when(F.abs(yards) < EXACT, yards.cast("string")).otherwise(F.format_string("%.0f", yards.cast("double"))), F.lit(" yd"))
    whole = F.floor(metres + 0.5)
    return F.when(whole >= 1000, F.concat(amount_text(metres / 1000), F.lit(" km"))).otherwise(F.concat(whole.cast("string"), F.lit(" m")))


def weight_text(grams: Column, system: str = "metric") -> Column:
    """Grams or kilograms; ounces, pounds from 16 ounces on."""
    if system == "imperial":
        oz = grams / GRAMS_PER_OUNCE
        return F.when(oz >= OUNCES_PER_POUND, F.concat(amount_text(oz / OUNCES_PER_POUND), F.lit(" lb"))).otherwise(F.concat(amount_text(oz), F.lit(" oz")))
    whole = F.floor(grams + 0.5)
    return F.when(whole >= 1000, F.concat(amount_text(grams / 1000), F.lit(" kg"))).otherwise(F.concat(whole.cast("string"), F.lit(" g")))


def to_canonical(raw: Column, kind: str, system: str = "metric") -> Column:
    """Typed length or weight to metres or grams; blank stays null."""
    factor = 1.0 if system == "metric" else {"length": METRES_PER_YARD, "weight": GRAMS_PER_OUNCE}[kind]
    return once(raw, lambda typed: F.when(has_value(typed), parse_decimal(typed) * factor))


def from_canonical(x: Column, kind: str, system: str = "metric") -> Column:
    """Metres or grams to the number shown for editing, three decimals at most."""
    factor = 1.0 if system == "metric" else {"length": METRES_PER_YARD, "weight": GRAMS_PER_OUNCE}[kind]
    return F.floor(x / factor * 1000 + 0.5).cast("double") / 1000


def minutes_text(seconds: Column) -> Column:
    """Rounded minutes as "h h mm min" (H16)."""
    minutes = F.floor(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)) / 60 + 0.5).cast("long")
    h, m = F.floor(minutes / 60).cast("long"), F.pmod(minutes, F.lit(60)).cast("long")
    return (
        F.when(h == 0, F.concat(m.cast("string"), F.lit(" min")))
        .when(m == 0, F.concat(h.cast("string"), F.lit(" h")))
        .otherwise(F.concat(h.cast("string"), F.lit(" h "), F.lpad(m.cast("string"), 2, "0"), F.lit(" min")))
    )


def clock_text(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.greatest(F.coalesce(seconds.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def spread_over_rows(occurrences: Column, rows: Column) -> Column:
    """``occurrences`` changes over ``rows``: every so many rows, how many get one row more, and changes a row if dense."""
    sparse = (occurrences > 0) & (rows >= occurrences)
    return F.struct(
        F.when(sparse, F.floor(rows / occurrences)).cast("long").alias("every"),
        F.when(sparse, rows % occurrences).cast("long").alias("longer"),
        F.when((occurrences > 0) & (rows > 0) & (rows < occurrences), F.ceil(occurrences / rows)).cast("long").alias("at_once"),
    )


def nearest(catalogue: list[float], x: Column) -> Column:
    """Catalogue value nearest to x; of two equally near the smaller."""
    pairs = F.array(*(F.struct(F.abs(F.lit(v) - x).alias("d"), F.lit(v).alias("v")) for v in catalogue))
    return F.when(x.isNotNull(), F.array_min(pairs)["v"])


def base64_bytes(encoded: Column) -> Column:
    """Bytes a base64 text stands for."""
    pad = F.length(encoded) - F.length(F.rtrim(encoded, F.lit("=")))
    return F.floor(F.length(encoded) * 3 / 4) - pad
