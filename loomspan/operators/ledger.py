"""Spend ledger: one relation of purchases, patterns and tools; totals never mix currencies (inventory B11-B15, B21-B31,
C22, C23, C36, D17-D26, F1-F4, G1, G3, K16, K23).

A line has ``id`` (text), ``kind``, ``quantity``, ``unit_price`` (text as typed), ``currency``, ``date`` (text, may be blank) and
``category``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.numbers import has_value, is_readable, parse_decimal, round2

CATEGORIES = ("yarn", "pattern", "tool")


def amount() -> Column:
    """Price times quantity; gifts and unreadable numbers are 0."""
    zero = F.lit(0.0)
    return F.when(F.col("kind") == "gift", zero).otherwise(F.coalesce(parse_decimal(F.col("unit_price")), zero) * F.coalesce(parse_decimal(F.col("quantity")), zero))


def money(column: str | Column) -> Column:
    """Sum of amounts, rounded; summed as decimals, so that it does not depend on the order of the rows."""
    c = F.col(column) if isinstance(column, str) else column
    return round2(F.sum(c.cast("decimal(24,6)")).cast("double"))


def price_unknown() -> Column:
    """Not a gift, and the price is blank or unreadable."""
    return ~F.coalesce(F.col("kind") == "gift", F.lit(False)) & ~(has_value(F.col("unit_price")) & is_readable(F.col("unit_price")))


def category() -> Column:
    """Pattern, tool, or yarn for everything else."""
    return F.when(F.col("category").isin("pattern", "tool"), F.col("category")).otherwise("yarn")


def year() -> Column:
    return F.substring(F.trim(F.coalesce("date", F.lit(""))), 1, 4)


def expense_lines(purchases: DataFrame, patterns: DataFrame, tools: DataFrame) -> DataFrame:
    """Purchases, and one line for every priced pattern of the library and every priced tool."""
    def line(df: DataFrame, prefix: str) -> DataFrame:
        return df.where(has_value(F.col("price"))).select(
            F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string")).alias("id"), F.lit("buy").alias("kind"), F.lit("1").alias("quantity"),
            F.col("price").alias("unit_price"), "currency", "date", F.lit({"pat": "pattern", "tool": "tool"}[prefix]).alias("category"), F.col("name").alias("label"),
        )

    own = purchases.withColumn("id", F.col("id").cast("string"))
    library = patterns.where(~F.coalesce("builtin", F.lit(False)) & F.col("owner_project_id").isNull())
    return own.unionByName(line(library, "pat"), allowMissingColumns=True).unionByName(line(tools, "tool"), allowMissingColumns=True)


def filter_year(lines: DataFrame, which: str) -> DataFrame:
    """``all``, ``unknown`` (blank date) or a year; chained with the category filter."""
    return lines if which in ("", "all") else lines.where(year() == ("" if which == "unknown" else which))


def filter_category(lines: DataFrame, which: str) -> DataFrame:
    """``all`` or one category."""
    return lines if which == "all" else lines.where(category() == which)


def by_currency(lines: DataFrame, *keys: str) -> DataFrame:
    """Total a currency; lines of amount 0 make no group."""
    priced = lines.withColumn("amount", amount()).groupBy(*keys, F.coalesce("currency", F.lit("")).alias("currency"))
    return priced.agg(money("amount").alias("amount"), F.count_if(F.col("amount") != 0).alias("n")).where("n > 0").drop("n")


def stock_value(items: DataFrame, fallback: str) -> DataFrame:
    """Value of a stock a currency; priced items of value 0 do make a group."""
    worth = F.coalesce(parse_decimal(F.col("price")), F.lit(0.0)) * F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))
    currency = F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit(fallback))
    return items.where(has_value(F.col("price"))).groupBy(currency.alias("currency")).agg(money(worth).alias("amount"))


def by_category(lines: DataFrame) -> DataFrame:
    """Totals of the three categories a currency, all three always there."""
    three = lines.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    totals = by_currency(lines.withColumn("category", category()), "category")
    return three.join(totals, "category", "left")


def rollup(lines: DataFrame) -> DataFrame:
    """Totals a month and a year for each currency; undated lines are the year "" (D20)."""
    dated = lines.select(F.coalesce("currency", F.lit("")).alias("currency"), amount().alias("amount"), year().alias("year"), F.substring(F.trim(F.coalesce("date", F.lit(""))), 1, 7).alias("month"))
    months = dated.groupBy("year", "month", "currency").agg(F.sum(F.col("amount").cast("decimal(24,6)")).alias("amount"), F.count(F.lit(1)).alias("lines"))
    years = months.groupBy("year", "currency").agg(F.sum("amount").alias("amount"), F.sum("lines").alias("lines")).withColumn("month", F.lit(None).cast("string"))
    return months.unionByName(years).withColumn("amount", round2(F.col("amount").cast("double")))


def newest_first(lines: DataFrame) -> DataFrame:
    """Date descending, undated last, then numeric id descending."""
    return lines.orderBy(F.desc_nulls_last(F.nullif(F.trim(F.col("date")), F.lit(""))), F.desc(F.coalesce(F.col("id").try_cast("long"), F.lit(0))))


def years(lines: DataFrame) -> DataFrame:
    """Years that occur, for a filter menu; taken from all lines."""
    return lines.select(year().alias("year")).distinct()


def yarn_totals(purchases: DataFrame) -> DataFrame:
    """Skeins, last date and distinct dye lots in first-seen order of each yarn."""
    lot = F.nullif(F.trim(F.col("lot")), F.lit(""))
    first = purchases.where(lot.isNotNull()).groupBy("yarn_id", lot.alias("lot")).agg(F.min("id").alias("at"))
    lots = first.groupBy("yarn_id").agg(F.sort_array(F.collect_list(F.struct("at", "lot"))).alias("x")).select("yarn_id", F.array_join(F.transform("x", lambda s: s["lot"]), " · ").alias("lots"))
    totals = purchases.groupBy("yarn_id").agg(
        money(F.coalesce(parse_decimal(F.col("quantity")), F.lit(0.0))).alias("skeins"), F.coalesce(F.max(F.nullif(F.col("date"), F.lit(""))), F.lit("")).alias("last_date")
    )
    return totals.join(lots, "yarn_id", "left").withColumn("lots", F.coalesce("lots", F.lit("")))


def stock_gap(yarns: DataFrame, purchases: DataFrame) -> DataFrame:
    """Stock and consumption less what the ledger says was acquired."""
    used = F.aggregate(F.map_values(F.coalesce("consumed", F.create_map().cast("map<bigint,double>"))), F.lit(0.0), lambda a, x: a + x)
    have = yarns.select(F.col("id").alias("yarn_id"), round2(F.coalesce("quantity", F.lit(0.0)) + used).alias("acquired"))
    return have.join(yarn_totals(purchases).select("yarn_id", "skeins"), "yarn_id", "left").select("yarn_id", round2(F.col("acquired") - F.coalesce("skeins", F.lit(0.0))).alias("gap"))


def labelled(lines: DataFrame, live: DataFrame) -> DataFrame:
    """Label of each line from the live item, or the label it was stored with if that is gone or blank."""
    names = live.select(F.col("id").alias("yarn_id"), F.col("label").alias("now"))
    return lines.join(names, "yarn_id", "left").withColumn("label", F.coalesce(F.nullif(F.trim(F.col("now")), F.lit("")), "label")).drop("now")


def backfill(live: DataFrame, trashed: DataFrame, purchases: DataFrame, currency: str) -> DataFrame:
    """Lines for yarns, live or in the trash, that the ledger does not know."""
    order = Window.partitionBy("id").orderBy("from_trash")
    both = live.withColumn("from_trash", F.lit(0)).unionByName(trashed.withColumn("from_trash", F.lit(1)))
    once = both.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    missing = once.join(purchases.select(F.col("yarn_id").alias("id")), "id", "left_anti")
    return missing.select(
        F.col("id").alias("yarn_id"), F.lit("buy").alias("kind"), F.col("quantity").cast("string").alias("quantity"), F.coalesce(F.col("price"), F.lit("")).alias("unit_price"),
        F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit(currency)).alias("currency"), F.lit("").alias("date"), F.lit(True).alias("reconstructed"),
    )


def fill_currency(items: DataFrame, currency: str) -> DataFrame:
    """Currency for priced items that have none; running it again changes nothing."""
    blank = ~has_value(F.col("currency"))
    return items.withColumn("currency", F.when(has_value(F.col("price")) & blank, F.lit(currency)).otherwise(F.col("currency")))


def price_state() -> Column:
    """none, unknown (unreadable), free or amount."""
    p = F.col("price")
    return F.when(~has_value(p), "none").when(~is_readable(p), "unknown").when(parse_decimal(p) == 0, "free").otherwise("amount")


def year_options(lines: DataFrame) -> DataFrame:
    """Values a year filter may have now: all, the years that occur, and unknown if some line has no date."""
    found = years(lines).select(F.when(F.col("year") == "", "unknown").otherwise(F.col("year")).alias("year"))
    return lines.sparkSession.createDataFrame([("all",)], "year string").union(found)
