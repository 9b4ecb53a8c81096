"""Tables, sheets, JSON trees and CSV (inventory A1-A10, A13-A16, A20-A24, A32, K17, K18).

Readers are lazy; defaults for fields that older rows lack are column expressions on top of the scan, so a filter still
reaches the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Defaults of fields that older rows lack, a table.
DEFAULTS = {
    "yarns": {"reservations": "map()", "consumed": "map()", "labels": "array()", "composition": "array()"},
    "projects": {"technique": "'knitting'", "tool_ids": "array()", "kit_picks": "array()"},
    "patterns": {"builtin": "false", "cover_index": "0"},
    "tools": {"status": "'owned'", "quantity": "1"},
}


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table with the defaults of its older rows filled in (A1-A10)."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return with_defaults(reader.parquet(f"{root}/{name}"), name)


def with_defaults(df: DataFrame, name: str) -> DataFrame:
    for column, value in DEFAULTS.get(name, {}).items():
        if column in df.columns:
            kind = df.schema[column].dataType.simpleString()
            df = df.withColumn(column, F.coalesce(F.col(column), F.expr(value).cast(kind)))
    return df


def seek(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows of one parent; the comparison is pushed to the scan."""
    return df.where(F.col(column) == F.lit(value))


def first_match(df: DataFrame, condition: str) -> DataFrame:
    """Any one row that fits; the scan ends early."""
    return df.where(condition).limit(1)


def read_sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV sheet with its own headers, all cells text; the header names decide, not their order."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', encoding="UTF-8")


def read_entries(spark: SparkSession, path: str, schema: T.StructType, skip: DataFrame | None = None, most_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """JSON entries of a folder tree, and the faults: a bad file is reported and the others go on.

    ``skip`` holds ids to leave out (those in the trash).  Files over ``most_bytes`` are reported, not read.
    """
    corrupt = "_corrupt"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    size, file = F.col("_metadata.file_size"), F.col("_metadata.file_path").alias("file")
    # the size is known from the listing, so files that are too large are pruned from the scan
    raw = (
        spark.read.schema(full).option("columnNameOfCorruptRecord", corrupt).option("mode", "PERMISSIVE").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
        .where(size <= most_bytes).select("*", file)
    )
    large = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(size > most_bytes).select(file, F.lit("too_large").alias("code"))
    good = F.col(corrupt).isNull() & F.col("id").isNotNull()
    entries = raw.where(good).drop(corrupt)
    if skip is not None:
        entries = entries.join(skip.select("id"), "id", "left_anti")
    return entries, raw.where(~good).select("file", F.when(F.col(corrupt).isNotNull(), "unreadable").otherwise("bad_id").alias("code")).unionByName(large)


def write_entries(df: DataFrame, path: str) -> None:
    """Registry sink: one JSON object a row; written whole, then committed."""
    df.write.mode("overwrite").json(path)


def write_snapshot(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """All tables under a new version folder; the manifest is written last, so a reader never sees half a snapshot."""
    base = f"{root}/{version}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n,) for n in sorted(tables)], "relation string").coalesce(1).write.mode("overwrite").json(f"{base}/_manifest")
    return base


def read_snapshot(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    names = [r["relation"] for r in spark.read.schema("relation string").json(f"{base}/_manifest").collect()]
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def host(url: Column) -> Column:
    """Host of a web address in lower case, without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def read_html_lines(pages: DataFrame, site: Column | None = None) -> DataFrame:
    """Text lines of raw web pages: scripts, styles and tags go, block tags end a line (A32 on web pages).

    With ``site`` that is the document and ``page_id`` its page; without, each page is a document of its own.  Lines are
    numbered among those with text, as the blank ones come from the markup.
    """
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    broken = F.regexp_replace(plain, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)\b[^>]*>", "\n")
    text = F.regexp_replace(broken, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    clean = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    doc, page = (F.col("page_id"), F.lit(0)) if site is None else (site, F.col("page_id"))
    return pages.select(doc.alias("doc"), page.alias("page"), F.posexplode(clean).alias("line_no", "text"))
