"""Progress through sections and steps (inventory A8, B26, B43, C35, D29, D30, E16-E24, H42, H43)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_progress(sections: DataFrame) -> DataFrame:
    """Rows done and in all, a project; sections without a total are left out, marked ones count as done."""
    done = F.when(F.coalesce("marked_done", F.lit(False)), F.col("rows_total")).otherwise(F.least(F.coalesce("rows_done", F.lit(0)), "rows_total"))
    return sections.where("rows_total > 0").groupBy("project_id").agg(F.sum(done).cast("long").alias("done"), F.sum("rows_total").cast("long").alias("total"))


def section_state(active: Column) -> Column:
    """done, wip, started or todo; the first that holds."""
    full = (F.col("rows_total") > 0) & (F.col("rows_done") >= F.col("rows_total"))
    return F.when(F.coalesce("marked_done", F.lit(False)) | full, "done").when(F.col("id") == active, "wip").when(F.coalesce("rows_done", F.lit(0)) > 0, "started").otherwise("todo")


def step_done() -> Column:
    """A repeat is done when its counter reaches its total (0 counts as done), other steps when marked."""
    return F.when(F.col("is_repeat"), F.coalesce("counter", F.lit(0)) >= F.coalesce("repeat_total", F.lit(0))).otherwise(F.coalesce("marked", F.lit(False)))


def reader_progress(steps: DataFrame) -> DataFrame:
    """Steps done and in all, a document; notes do not count."""
    return steps.where(~F.coalesce("note", F.lit(False))).groupBy("doc").agg(F.count_if(step_done()).alias("done"), F.count(F.lit(1)).alias("total"))


def current_step(steps: DataFrame, last: DataFrame) -> DataFrame:
    """The step last touched if it is not done, else the first open one after it, else the first open one."""
    open_steps = steps.where(~F.coalesce("note", F.lit(False)) & ~step_done()).join(last.select("doc", F.col("pos").alias("last_pos")), "doc", "left")
    later = F.min(F.when(F.col("pos") >= F.col("last_pos"), F.col("pos")))
    return open_steps.groupBy("doc").agg(F.coalesce(later, F.min("pos")).alias("pos"))


def step_positions(steps: DataFrame) -> DataFrame:
    """Place and number of countable steps in each section."""
    section = Window.partitionBy("doc", "section")
    return steps.where(~F.coalesce("note", F.lit(False))).select("doc", "section", "pos", F.row_number().over(section.orderBy("pos")).alias("place"), F.count(F.lit(1)).over(section).alias("of"))


def working_copy(copies: DataFrame) -> DataFrame:
    """Copy of a repeated section to work on: the least advanced, the first of equals; done ones last."""
    left = F.struct((F.col("done") >= F.col("total")).alias("a"), F.col("done").alias("b"), F.col("copy").alias("c"))
    return copies.groupBy("doc", "section").agg(F.min(left).alias("m")).select("doc", "section", F.col("m.c").alias("copy"))


def combined_progress(sections: DataFrame, reader: DataFrame) -> DataFrame:
    """Section progress where a total is known, else reader progress."""
    s, r = sections.select("project_id", F.struct("done", "total").alias("s")), reader.select("project_id", F.struct("done", "total").alias("r"))
    p = F.coalesce(F.when(F.col("s.total") > 0, F.col("s")), F.col("r"))
    return s.join(r, "project_id", "full").select("project_id", p["done"].alias("done"), p["total"].alias("total"))


def last_place(last: DataFrame, steps: DataFrame) -> DataFrame:
    """The step last touched if it still exists, else null; there is no fallback."""
    there = steps.select("doc", "pos", F.lit(True).alias("there")).distinct()
    return last.join(there, ["doc", "pos"], "left").select("doc", F.when(F.col("there"), F.col("pos")).alias("pos"))


def chart_before(steps: DataFrame) -> DataFrame:
    """For each step the nearest visible chart before it, looking back no further than the last tracked step.
    ``steps`` has ``is_chart``, ``visible`` and ``tracked``."""
    order = Window.partitionBy("doc").orderBy("pos")
    run = F.coalesce(F.sum(F.col("tracked").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("doc", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    chart = F.last(F.when(F.col("is_chart") & F.col("visible"), F.col("pos")), ignorenulls=True).over(within)
    return steps.withColumn("run", run).select("doc", "pos", chart.alias("chart"))


def section_instructions(size: Column) -> Column:
    """Text of a section for a size, else the common one, else "" (B43).  Reads ``by_size`` (map) and ``instructions``."""
    own = F.nullif(F.try_element_at(F.coalesce("by_size", F.create_map().cast("map<string,string>")), size), F.lit(""))
    return F.coalesce(own, "instructions", F.lit(""))
