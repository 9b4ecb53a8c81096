"""Tools, kits and what projects take of them (inventory B10, B24, B35-B38, C4-C19, D35-D38, F6, F7, G10, H18-H20, K20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import catalogues
from loomspan.functions.fibres import cables
from loomspan.functions.numbers import hundredths, with_decimal_mark
from loomspan.operators.assembly import renumber


def sizes() -> Column:
    """Sizes a tool offers, ascending and distinct: those of a kit, or its own."""
    own = F.when(F.col("size_mm").isNotNull(), F.array("size_mm")).otherwise(F.array().cast("array<double>"))
    return F.when(F.col("category") == "kit", F.array_sort(F.array_distinct(F.coalesce("kit_sizes", F.array().cast("array<double>"))))).otherwise(own)


def linked_tools(projects: DataFrame, tools: DataFrame) -> DataFrame:
    """Tools of each project in the order it lists them; ids that do not exist go."""
    # repeated ids are told within a project's list, so no task has to hold all pairs of its projects at once
    listed = projects.select(F.col("id").alias("project_id"), "tool_ids", F.explode(F.array_distinct("tool_ids")).alias("tool_id"))
    first = listed.select("project_id", "tool_id", (F.array_position("tool_ids", F.col("tool_id")) - 1).cast("int").alias("place"))
    return first.join(tools.select(F.col("id").alias("tool_id"), "name"), "tool_id")


def projects_using(projects: DataFrame) -> DataFrame:
    """tool_id, project_id for every project that lists the tool."""
    return projects.select(F.explode(F.array_distinct("tool_ids")).alias("tool_id"), F.col("id").alias("project_id"), "status")


def in_use(projects: DataFrame) -> DataFrame:
    """Tools that a project under way holds, with the first such project."""
    return projects_using(projects).where("status = 'wip'").groupBy("tool_id").agg(F.min("project_id").alias("project_id"), F.count(F.lit(1)).alias("holders"))


def free_tools(tools: DataFrame, projects: DataFrame) -> DataFrame:
    """Tools of which some copy is held by no project under way."""
    held = in_use(projects).select(F.col("tool_id").alias("id"), "holders")
    left = F.coalesce("quantity", F.lit(1)) - F.coalesce("holders", F.lit(0))
    return tools.join(held, "id", "left").withColumn("free", left.cast("long")).where("free > 0")


def valid_picks(projects: DataFrame, tools: DataFrame) -> DataFrame:
    """Kit picks whose tool exists and offers the size to a hundredth; repeated ones once."""
    picks = projects.select(F.col("id").alias("project_id"), "status", F.posexplode("kit_picks").alias("place", "pick"))
    picks = picks.select("project_id", "status", "place", F.col("pick.tool_id").alias("tool_id"), hundredths(F.col("pick.size_mm")).alias("size"), F.col("pick.cable_cm").alias("cable_cm"))
    offers = tools.select(F.col("id").alias("tool_id"), F.explode(sizes()).alias("mm")).select("tool_id", hundredths(F.col("mm")).alias("size")).distinct()
    order = Window.partitionBy("project_id", "tool_id", "size", "cable_cm").orderBy("place")
    return picks.join(offers, ["tool_id", "size"]).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def cable_counts(tools: DataFrame) -> DataFrame:
    """Copies of each cable a kit holds."""
    return tools.select(F.col("id").alias("tool_id"), F.explode("kit_cables").alias("c")).groupBy("tool_id", F.col("c.cm").alias("cable_cm")).agg(F.count(F.lit(1)).alias("copies"))


def cable_use(tools: DataFrame, projects: DataFrame) -> DataFrame:
    """Copies of each cable and how many projects under way took one."""
    taken = valid_picks(projects, tools).where("status = 'wip' AND cable_cm IS NOT NULL").groupBy("tool_id", "cable_cm").agg(F.count(F.lit(1)).alias("taken"))
    return cable_counts(tools).join(taken, ["tool_id", "cable_cm"], "left").select("tool_id", "cable_cm", "copies", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def missing_sizes(requested: DataFrame, tools: DataFrame) -> DataFrame:
    """Requested sizes, to a hundredth, that no tool offers."""
    owned = tools.select(F.explode(sizes()).alias("mm")).select(hundredths(F.col("mm")).alias("size")).distinct()
    return requested.select(hundredths(F.col("size_mm")).alias("size")).where("size IS NOT NULL").distinct().join(owned, "size", "left_anti")


def owned_sizes(tools: DataFrame) -> DataFrame:
    """Distinct sizes that some tool offers."""
    return tools.select(F.explode(sizes()).alias("size_mm")).distinct()


def group_by_size(tools: DataFrame) -> DataFrame:
    """size, tool_id: a kit appears under each of its sizes, a tool without size under null."""
    return tools.select(F.col("id").alias("tool_id"), F.explode_outer(sizes()).alias("size_mm"))


def group_by_type(tools: DataFrame, order: list[str]) -> DataFrame:
    """Tools of each known type, types in their fixed order, smallest first size first (D37, F6).  Types are few, so they are ranked by
    ranges of tools and not one task a type."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    least = F.array_min(sizes())
    known = tools.where(place > 0).select("type", place.cast("int").alias("place"), "id", least.isNull().alias("_none"), least.alias("_least"))
    return renumber(known, "type", ["_none", "_least", "id"], "rank").select("type", "place", "id", (F.col("rank") + 1).cast("int").alias("rank"))


def filter_tools(tools: DataFrame, size_mm: float | None = None, query: str = "") -> DataFrame:
    """By size and by text in the name."""
    if size_mm is not None:
        tools = tools.where(F.array_contains(F.transform(sizes(), hundredths), F.lit(int(size_mm * 100 + 0.5))))
    return tools.where(F.contains(F.lower("name"), F.lit(query.strip().lower()))) if query.strip() else tools


def picker_order(tools: DataFrame, wanted: list[float]) -> DataFrame:
    """Adds whether a tool offers a wanted size; such tools come first."""
    want = F.array(*(F.lit(int(w * 100 + 0.5)) for w in wanted)) if wanted else F.array().cast("array<int>")
    return tools.withColumn("matching", F.arrays_overlap(F.transform(sizes(), hundredths), want)).orderBy(F.desc("matching"), "id")


def relink(current: DataFrame, parked: DataFrame, *keys: str) -> DataFrame:
    """Union of what a project holds and what it had parked; what it holds wins."""
    order = Window.partitionBy(*keys).orderBy("rank")
    both = current.withColumn("rank", F.lit(0)).unionByName(parked.withColumn("rank", F.lit(1)))
    return both.withColumn("first", F.row_number().over(order)).where("first = 1").drop("rank", "first")


def is_kit() -> Column:
    """Whether the type of a tool is a kit of sizes."""
    return F.col("type").isin([t for t, size in catalogues.TOOL_SIZES.items() if size == "kit"])


def tool_cables() -> Column:
    """Cables of a kit, sorted; other tools have none."""
    return F.when(is_kit(), cables(F.col("kit_cables"))).otherwise(F.array().cast("array<struct<cm:double,join:string>>"))


def size_text(us: Column, mark: str = ".") -> Column:
    """Size of a tool as a label: the span of a kit of several sizes, else millimetres and the US number if there is one, ""
    without a size (B38)."""
    mm = lambda c: with_decimal_mark(F.regexp_replace(c.cast("string"), r"\.0$", ""), mark)
    own = sizes_by_type()
    one = F.try_element_at(own, F.lit(1))
    single = F.concat(mm(one), F.lit(" mm"), F.coalesce(F.concat(F.lit(" · US "), us), F.lit("")))
    span = F.concat(mm(one), F.lit(" – "), mm(F.try_element_at(own, F.lit(-1))), F.lit(" mm"))
    return F.when(is_kit() & (F.size(own) > 1), span).otherwise(F.coalesce(single, F.lit("")))


def sizes_by_type() -> Column:
    """Sizes of a tool by its type: a kit's own list, ascending and distinct, else its size."""
    own = F.when(F.col("size_mm").isNotNull(), F.array("size_mm")).otherwise(F.array().cast("array<double>"))
    return F.when(is_kit(), F.array_sort(F.array_distinct(F.coalesce("kit_sizes", F.array().cast("array<double>"))))).otherwise(own)
