"""Export tables and tool dimensions (inventory A28-A31, B24, B33, H18-H21, H47)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import catalogues, numbers


def size_dimension(like: DataFrame) -> DataFrame:
    """Needle sizes with their US and UK numbers."""
    return like.sparkSession.createDataFrame(catalogues.KNITTING_SIZES, "mm double, us string, uk string").withColumn("size", numbers.hundredths(F.col("mm")))


def with_equivalents(tools: DataFrame) -> DataFrame:
    """US and UK number of each tool's size; the dimension has 29 rows."""
    dim = size_dimension(tools).select("size", "us", "uk")
    return tools.withColumn("size", numbers.hundredths(F.col("size_mm"))).join(F.broadcast(dim), "size", "left").drop("size")


def requested_mm(entries: DataFrame) -> DataFrame:
    """Size asked for: a readable "4,5 mm", else the one size with that US number; typed but unreadable is null."""
    typed = F.trim(F.regexp_replace(F.trim(F.coalesce("mm", F.lit(""))), r"(?i)\s*mm$", ""))
    by_us = size_dimension(entries).where("us IS NOT NULL").groupBy(F.upper("us").alias("us_key")).agg(F.min("mm").alias("us_mm"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    joined = entries.withColumn("us_key", F.upper(F.trim("us"))).join(F.broadcast(by_us), "us_key", "left")
    number = numbers.parse_decimal(typed)
    return joined.withColumn("size_mm", F.when(typed != "", F.when(number > 0, number)).otherwise(F.col("us_mm"))).drop("us_key", "us_mm")


def serves(technique: str) -> Column:
    """Whether a tool's size scale is that of the technique."""
    hook = F.col("type").isin(list(catalogues.HOOK_SCALE_TYPES))
    return F.col("type").isin(list(catalogues.TOOL_TYPES)) & (hook if technique == "crochet" else ~hook)


def recommended_mm(label_mm: Column, label_stitches: Column, target_stitches: Column, technique: str) -> Column:
    """Rule of three on the label's gauge, then the nearest size of the catalogue; the label's own within 2 %."""
    same = F.abs(label_stitches / target_stitches - 1) <= 0.02
    raw = label_mm * label_stitches / target_stitches
    good = (label_mm > 0) & (label_stitches > 0) & (target_stitches > 0)
    return F.when(good & same, label_mm).when(good, numbers.nearest(catalogues.RECOMMENDED_MM[technique], raw))


def normalized_tool() -> list[Column]:
    """Category from the type, and no size, kit sizes or cables where the type has none."""
    pairs = F.create_map(*(F.lit(x) for kv in catalogues.TOOL_TYPES.items() for x in kv))
    kit = F.coalesce(pairs[F.col("type")] == "kit", F.lit(False))
    return [
        F.coalesce(pairs[F.col("type")], F.lit("needle")).alias("category"), F.when(~kit & (F.col("type") != "cable"), F.col("size_mm")).alias("size_mm"),
        F.when(kit, F.col("kit_sizes")).otherwise(F.array().cast("array<double>")).alias("kit_sizes"),
    ]


def yarn_export(yarns: DataFrame, totals: DataFrame, system: str = "metric", mark: str = ",") -> DataFrame:
    """One row a yarn with lots and last purchase from the ledger, lengths and weights in the chosen system."""
    t = totals.select(F.col("yarn_id").alias("id"), "lots", "last_date")
    number = lambda c: numbers.with_decimal_mark(numbers.amount_text(c), mark)
    return yarns.join(t, "id", "left").select(
        "id", "brand", "model", "color", "weight", number(F.col("quantity")).alias("quantity"), number(numbers.from_canonical(numbers.parse_decimal(F.col("length_m")), "length", system)).alias("length"),
        number(numbers.from_canonical(numbers.parse_decimal(F.col("grams")), "weight", system)).alias("weight_of_skein"), F.array_join("composition", " / ").alias("composition"), F.array_join("labels", " / ").alias("labels"),
        "price", "currency", F.coalesce("lots", F.lit("")).alias("lots"), F.coalesce("last_date", F.lit("")).alias("last_date"), "notes",
    )


def project_export(projects: DataFrame) -> DataFrame:
    """Twelve columns of a project; needles as texts joined by a slash."""
    return projects.select("id", "name", "technique", "status", "started_at", "finished_at", F.array_join(F.transform("needles", lambda n: F.concat(n["mm"].cast("string"), F.lit(" mm"))), " / ").alias("needles"), F.array_join("sizes", " / ").alias("sizes"), "stars")


def pattern_export(patterns: DataFrame) -> DataFrame:
    """A pattern with the number of its sections."""
    return patterns.select("id", "name", "category", "author", F.size("sections").alias("sections"), "price", "currency")


def tool_export(tools: DataFrame) -> DataFrame:
    """A tool with its size numbers, kit sizes and cables as text."""
    cables = F.array_join(F.transform("kit_cables", lambda c: F.concat(c["cm"].cast("int").cast("string"), F.lit(" cm"), F.coalesce(F.concat(F.lit(" "), F.upper(c["join"])), F.lit("")))), " ; ")
    return with_equivalents(tools).select("id", "name", "category", "type", "size_mm", "us", "uk", F.array_join(F.transform("kit_sizes", lambda s: s.cast("string")), " / ").alias("kit_sizes"), cables.alias("kit_cables"), "quantity", "status")
