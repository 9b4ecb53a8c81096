"""Stock and reservations: maps of project to quantity, availability, states, searches and facets (inventory B1-B9, B27,
C20-C22, D27, D28, D31-D34, F1, F2, G5-G13, K8-K15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import catalogues
from loomspan.functions.numbers import has_value, parse_decimal, round2
from loomspan.functions.text import distinct_trimmed

_MAP = "map<bigint,double>"


def quantities(m: Column) -> Column:
    """A reservation or consumption map with its numbers rounded and what is not above 0 removed."""
    m = F.coalesce(m.cast(_MAP), F.create_map().cast(_MAP))
    return F.map_filter(F.transform_values(m, lambda _, v: round2(v)), lambda _, v: v > 0)


def total(m: Column) -> Column:
    return round2(F.aggregate(F.map_values(quantities(m)), F.lit(0.0), lambda a, x: a + x))


def with_availability(yarns: DataFrame) -> DataFrame:
    """Adds ``reserved`` and ``available``, never below 0."""
    reserved = total(F.col("reservations"))
    free = round2(F.coalesce("quantity", F.lit(0.0)) - reserved)
    return yarns.withColumn("reserved", reserved).withColumn("available", F.greatest(free, F.lit(0.0)))


def available_for(project: Column) -> Column:
    """What a project may reserve: all but what others hold."""
    others = F.map_filter(quantities(F.col("reservations")), lambda k, _: k != project)
    return F.greatest(round2(F.coalesce("quantity", F.lit(0.0)) - F.aggregate(F.map_values(others), F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))


def reserve(yarns: DataFrame, project: Column, amount: Column) -> DataFrame:
    """Set a project's reservation, clamped to what it may take; 0 or less removes it (K8)."""
    want = F.least(round2(amount), available_for(project))
    rest = F.map_filter(quantities(F.col("reservations")), lambda k, _: k != project)
    return yarns.withColumn("reservations", F.when(want > 0, F.map_concat(rest, F.create_map(project.cast("bigint"), want))).otherwise(rest))


def consume(yarns: DataFrame, project: Column, used: Column) -> DataFrame:
    """A project's reservation becomes consumption: the stock falls by what was used, at most what it may take; without a
    reservation nothing is used (K9)."""
    own = F.coalesce(F.try_element_at(quantities(F.col("reservations")), project.cast("bigint")), F.lit(0.0))
    took = F.when(own > 0, F.greatest(F.least(round2(used), available_for(project)), F.lit(0.0))).otherwise(0.0)
    before = F.coalesce(F.try_element_at(quantities(F.col("consumed")), project.cast("bigint")), F.lit(0.0))
    others = F.map_filter(quantities(F.col("consumed")), lambda k, _: k != project)
    out = yarns.withColumns({"_took": took, "_before": before, "_others": others})
    now = round2(F.col("_before") + F.col("_took"))
    return out.withColumns(
        {
            "quantity": round2(F.col("quantity") - F.col("_took")),
            "reservations": F.map_filter(quantities(F.col("reservations")), lambda k, _: k != project),
            "consumed": F.when(now > 0, F.map_concat("_others", F.create_map(project.cast("bigint"), now))).otherwise(F.col("_others")),
        }
    ).drop("_took", "_before", "_others")


def correct_consumption(yarns: DataFrame, project: Column, used: Column) -> DataFrame:
    """Set what a project used, the stock balanced by the difference; doing it again changes nothing."""
    before = F.coalesce(F.try_element_at(quantities(F.col("consumed")), project.cast("bigint")), F.lit(0.0))
    free = F.greatest(round2(F.coalesce("quantity", F.lit(0.0)) - total(F.col("reservations"))), F.lit(0.0))
    now = F.greatest(F.least(round2(used), round2(before + free)), F.lit(0.0))
    others = F.map_filter(quantities(F.col("consumed")), lambda k, _: k != project)
    out = yarns.withColumns({"_now": now, "_before": before, "_others": others})
    return out.withColumns(
        {"quantity": round2(F.col("quantity") + F.col("_before") - F.col("_now")), "consumed": F.when(F.col("_now") > 0, F.map_concat("_others", F.create_map(project.cast("bigint"), F.col("_now")))).otherwise(F.col("_others"))}
    ).drop("_now", "_before", "_others")


def edges(yarns: DataFrame, column: str = "reservations") -> DataFrame:
    """yarn_id, project_id, quantity: one row for every map entry."""
    return yarns.select(F.col("id").alias("yarn_id"), F.explode(quantities(F.col(column))).alias("project_id", "quantity"))


def usage_state(yarns: DataFrame, projects: DataFrame) -> DataFrame:
    """used, usedPartial, reserved or free, from stock, consumption and the statuses of reserving projects."""
    held = edges(yarns).join(projects.select(F.col("id").alias("project_id"), "status"), "project_id", "left")
    # a project that is gone is never done
    held = held.groupBy("yarn_id").agg(F.bool_and(F.coalesce(F.col("status") == "done", F.lit(False))).alias("all_done"))
    stock = F.coalesce("quantity", F.lit(0.0))
    used = F.least(total(F.col("reservations")), stock)
    state = (
        F.when((stock == 0) & (F.size(quantities(F.col("consumed"))) > 0), "used").when(used <= 0, "free").when(~F.coalesce("all_done", F.lit(False)), "reserved")
        .when(used >= stock, "used").otherwise("usedPartial")
    )
    return yarns.join(held, yarns["id"] == held["yarn_id"], "left").select("id", state.alias("state"))


def project_usage(yarns: DataFrame) -> DataFrame:
    """Skeins a project holds or has used of each yarn."""
    both = edges(yarns).unionByName(edges(yarns, "consumed"))
    return both.groupBy("project_id", "yarn_id").agg(round2(F.sum("quantity")).alias("skeins")).where("skeins > 0")


def project_cost(yarns: DataFrame, fallback: str) -> DataFrame:
    """Cost of each project a currency, and how many of its yarns have a price noted; an unreadable one counts as 0."""
    price = F.when(has_value(F.col("price")), F.coalesce(parse_decimal(F.col("price")), F.lit(0.0)))
    # a yarn's row has what each project holds and has used of it, so both are added there and the stock is read once
    both = F.map_zip_with(quantities(F.col("reservations")), quantities(F.col("consumed")), lambda _, held, used: round2(F.coalesce(held, F.lit(0.0)) + F.coalesce(used, F.lit(0.0))))
    usage = yarns.select(price.alias("price"), F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit(fallback)).alias("currency"), F.explode(both).alias("project_id", "skeins"))
    return usage.where("skeins > 0").groupBy("project_id", "currency").agg(
        round2(F.sum(F.coalesce(F.col("price") * F.col("skeins"), F.lit(0.0)).cast("decimal(24,6)")).cast("double")).alias("amount"), F.count("price").alias("priced"), F.count_if(F.col("price").isNull()).alias("unpriced")
    )


def projects_all_labelled(yarns: DataFrame, label: str) -> DataFrame:
    """Projects with at least one yarn, all of whose yarns carry a label (C20)."""
    mark = yarns.select(F.col("id").alias("yarn_id"), F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), label).alias("has"))
    return project_usage(yarns).join(mark, "yarn_id").groupBy("project_id").agg(F.bool_and("has").alias("all")).where("all").select("project_id")


def color_family(color: Column) -> Column:
    """Name of the palette colour that is stored exactly so, ``__custom__`` for another colour, "" for none."""
    low, high = catalogues.LIGHTNESS
    names = F.create_map(*(F.lit(x) for name, h, s, light in catalogues.PALETTE for x in (f"hsl({h} {s}% {min(max(light, low), high)}%)", name)))
    return F.when(F.coalesce(color, F.lit("")) == "", "").otherwise(F.coalesce(F.try_element_at(names, color), F.lit("__custom__")))


def matches_color(family: str) -> Column:
    """An empty family keeps everything; a yarn without colour is of none."""
    return F.lit(True) if not family else color_family(F.col("color_value")) == family


def matches_state(state: str) -> Column:
    """Predicate over the derived ``state``."""
    return F.lit(True) if not state else F.col("state") == state


def asks_consumption(changes: DataFrame, yarns: DataFrame) -> DataFrame:
    """Status changes (project_id, status) that must ask first what was used: to done or abandoned, of a project that some
    yarn is reserved for; ``asks`` tells (K15)."""
    held = edges(yarns).select("project_id").distinct().withColumn("held", F.lit(True))
    return changes.join(held, "project_id", "left").withColumn("asks", F.col("status").isin("done", "abandoned") & F.coalesce("held", F.lit(False))).drop("held")


def matches(query: str = "", brand: str = "", weight: str = "", grams: str = "", material: str = "", label: str = "") -> Column:
    """The combined search predicate over a yarn; empty criteria keep everything."""
    out = F.lit(True)
    if query.strip():
        text = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("brand", "model", "color", "notes")), F.array_join(F.col("labels"), " ")))
        out &= F.contains(text, F.lit(query.strip().lower()))
    if brand:
        out &= F.coalesce(F.trim("brand"), F.lit("")) == ("" if brand == "__none__" else brand)
    if weight:
        out &= F.col("weight") == weight
    if grams:
        out &= has_value(F.col("grams")) & (parse_decimal(F.col("grams")) == parse_decimal(F.lit(grams)))
    if material:
        out &= F.array_contains(distinct_trimmed(F.col("composition")), material)
    if label:
        out &= F.array_contains(F.transform(distinct_trimmed(F.col("labels")), F.lower), label)
    return out


def weight_rank(weight: Column, order: tuple[str, ...]) -> Column:
    """Place in the catalogue; unknown weights come last (F2)."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), weight), F.lit(0).cast("long")), F.lit(999).cast("long"))


def sort_yarns(yarns: DataFrame, by: str, order: tuple[str, ...] = (), latest: DataFrame | None = None) -> DataFrame:
    """By brand, by weight then brand, or by last purchase (undated last) then brand (F1)."""
    brand = F.collate(F.lower(F.coalesce("brand", F.lit(""))), "UNICODE")
    if by == "weight":
        return yarns.orderBy(weight_rank(F.col("weight"), order), brand, "id")
    if by == "date":
        return yarns.join(latest, yarns["id"] == latest["yarn_id"], "left").orderBy(F.desc_nulls_last(F.nullif(F.col("last_date"), F.lit(""))), brand, "id")
    return yarns.orderBy(brand, "id")


def brand_options(yarns: DataFrame, catalogue: list[str]) -> DataFrame:
    """Catalogue and brands in stock, distinct."""
    known = yarns.sparkSession.createDataFrame([(b,) for b in catalogue], "brand string")
    return known.union(yarns.select(F.trim("brand").alias("brand")).where("brand <> ''")).distinct()


def present(yarns: DataFrame, column: str, catalogue: list[str]) -> DataFrame:
    """Values in stock, catalogue ones with their place, others without."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, catalogue)), F.col(column)), F.lit(0).cast("long"))
    return yarns.select(column).where(F.col(column).isNotNull()).distinct().withColumn("place", place)


def grams_options(yarns: DataFrame) -> DataFrame:
    """Distinct weights by value, each with the first text that says so."""
    number = parse_decimal(F.col("grams"))
    return yarns.where(has_value(F.col("grams")) & number.isNotNull()).groupBy(number.alias("value")).agg(F.min_by("grams", "id").alias("grams"))


def stock_totals(yarns: DataFrame) -> DataFrame:
    """Skeins, metres and grams in stock."""
    q = F.coalesce("quantity", F.lit(0.0))
    each = {"skeins": q, "metres": q * F.coalesce(parse_decimal(F.col("length_m")), F.lit(0.0)), "grams": q * F.coalesce(parse_decimal(F.col("grams")), F.lit(0.0))}
    return yarns.agg(*(round2(F.coalesce(F.sum(e), F.lit(0.0))).alias(k) for k, e in each.items()))


def count_by_category(patterns: DataFrame, catalogue: list[str]) -> DataFrame:
    """Count of each catalogue category, zeros too, and of everything under ``all``."""
    dim = patterns.sparkSession.createDataFrame([(c,) for c in catalogue], "category string")
    each = dim.join(patterns.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return each.unionByName(patterns.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("category"), "n"))


def composition_summary(usage: DataFrame, yarns: DataFrame) -> DataFrame:
    """Fibres of a project's yarns, ordered distinct, first seen first (D41).  ``usage`` has project_id, yarn_id and pos."""
    listed = usage.join(yarns.select(F.col("id").alias("yarn_id"), F.posexplode(distinct_trimmed(F.col("composition"))).alias("place", "fibre")), "yarn_id")
    first = listed.groupBy("project_id", "fibre").agg(F.min(F.struct("pos", "place")).alias("at"))
    return first.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "fibre"))), lambda s: s["fibre"]), ", ").alias("fibres"))
