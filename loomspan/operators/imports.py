"""Import of stash sheets: headers by name, typed rows, three-way split; and CSV export (inventory A16-A19, A26-A31, B25,
B33, C24, H31, H32)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import catalogues
from loomspan.functions.dates import import_date
from loomspan.functions.numbers import METRES_PER_YARD, round2, to_number
from loomspan.functions.text import csv_cell, first_keyword, fold, header_key, joined_key

FIELDS = sorted({*catalogues.HEADERS.values()})


def _key(header: str) -> str:
    """``header_key`` of a column name; names are few and known before anything runs."""
    plain = "".join(c for c in unicodedata.normalize("NFD", header.lower()) if not unicodedata.combining(c))
    return " ".join(re.sub("[_-]+", " ", plain).split())


def header_fields(headers: list[str]) -> list[tuple[str, str | None]]:
    """Field of every header, "" for derived columns to skip, null for unknown ones."""
    return [(h, "" if _key(h) in catalogues.IGNORED_HEADERS else catalogues.HEADERS.get(_key(h))) for h in headers]


def header_rows(headers: DataFrame, column: str = "header") -> DataFrame:
    """The same for headers that are data: ``field`` is "" for derived ones and null for unknown ones."""
    known = F.create_map(*(F.lit(x) for kv in catalogues.HEADERS.items() for x in kv))
    key = header_key(F.col(column))
    return headers.withColumn("field", F.when(key.isin(list(catalogues.IGNORED_HEADERS)), "").otherwise(F.try_element_at(known, key)))


def rename_sheet(sheet: DataFrame) -> DataFrame:
    """A sheet with its columns renamed by their headers, whatever their order; unknown columns go, blank rows too."""
    known: dict[str, Column] = {}
    for name, field in header_fields(sheet.columns):
        if field and field not in known:
            known[field] = F.col(f"`{name}`").cast("string").alias(field)
    out = sheet.select(*known.values(), *(F.lit(None).cast("string").alias(f) for f in FIELDS if f not in known))
    return out.where(F.length(F.trim(F.concat_ws("", *FIELDS))) > 0)


def map_rows(rows: DataFrame) -> DataFrame:
    """Typed yarn and purchase of each sheet row."""
    quantity, paid = to_number(F.col("quantity")), to_number(F.col("total_price"))
    yards = to_number(F.col("yards"))
    own, family = (F.nullif(F.trim(c), F.lit("")) for c in ("color", "color_family"))
    typed = rows.withColumn("color_from_family", own.isNull() & family.isNotNull()).withColumn("color", F.coalesce(own, family, F.lit("")))
    return typed.select(
        "*", quantity.alias("skeins"), F.when(quantity > 0, round2(paid / quantity)).alias("unit_price"),
        F.coalesce(to_number(F.col("metres")), round2(yards * METRES_PER_YARD)).alias("length_m"), to_number(F.col("grams")).alias("weight_g"),
        first_keyword(F.col("weight"), catalogues.WEIGHT_KEYWORDS).alias("weight_class"), import_date(F.col("date")).alias("bought_on"),
    )


def classify(rows: DataFrame, existing: DataFrame, pos: str = "pos") -> DataFrame:
    """status (not in stash), present (in stock, or seen before in the sheet) or new, for every row.

    A yarn is known by its folded brand, model and colour; a row whose colour was taken from its family also by one stored
    without colour.
    """
    keyed = rows.withColumn("key", joined_key(F.col("brand"), F.col("model"), F.col("color"))).withColumn("bare", joined_key(F.col("brand"), F.col("model"), F.lit("")))
    stored = existing.select(joined_key(F.col("brand"), F.col("model"), F.col("color")).alias("stored")).distinct()
    stash = F.coalesce(fold(F.col("status")) == "in stash", F.lit(False))
    family = F.coalesce("color_from_family", F.lit(False)) if "color_from_family" in rows.columns else F.lit(False)
    exact = stored.select(F.col("stored").alias("key"), F.lit(True).alias("known"))
    bare = stored.select(F.col("stored").alias("bare"), F.lit(True).alias("known_bare"))
    keyed = keyed.withColumn("in_stash", stash)
    # one row a key, so that rows without any name, which share one, need no window of their own
    first = keyed.where("NOT in_stash").groupBy("key").agg(F.min(pos).alias("first_pos")), keyed.where("in_stash").groupBy("key").agg(F.min(pos).alias("first_stash"))
    seen = F.col(pos) > F.when(F.col("in_stash"), F.col("first_stash")).otherwise(F.col("first_pos"))
    joined = keyed.join(exact, "key", "left").join(bare, "bare", "left").join(first[0], "key", "left").join(first[1], "key", "left")
    kind = F.when(~F.col("in_stash"), "status").when(F.col("known") | (F.col("known_bare") & family) | seen, "present").otherwise("new")
    return joined.withColumn("class", kind).drop("bare", "known", "known_bare", "in_stash", "first_pos", "first_stash")


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text ``line`` a row, ``;`` between the cells, formulas guarded."""
    kinds = dict(df.dtypes)
    return df.select(F.concat_ws(";", *(csv_cell(F.col(c), kinds[c] == "string") for c in columns)).alias("line"))


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """Export as part files with CRLF ends, each with a byte order mark and the header line before its rows.

    The last stage writes the lines as they come, one file a task, so every file begins with them however ``df`` is
    partitioned; a task without rows writes none.
    """
    head = "\ufeff" + ";".join(columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if b.num_rows:
                lines = b.column("line")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([head], lines.type), lines]) if first else lines], names=["line"])
                first = False

    # one record a file must not be split again by the writer's own limit
    csv_lines(df, columns).mapInArrow(headed, "line string").write.mode("overwrite").option("lineSep", "\r\n").option("maxRecordsPerFile", 0).text(path)
