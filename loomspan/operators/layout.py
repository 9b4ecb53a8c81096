"""Positioned text and shapes: rows from glyphs, columns, merged boxes, images next to lines (inventory C26-C28, F9,
L30-L33, L41-L43).

Everything that walks a page's items in order is a window over one page; the transitive merge of boxes is a graph of
overlapping boxes whose components are found by star steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.components import components
from loomspan.operators.lineage import cut


def rows_of(items: DataFrame, most_gap: float = 3.0) -> DataFrame:
    """Glyph runs (doc, page, x, y, width, text) to lines: a new row where y falls by more than the gap, cells in order of
    x joined by blanks (L30)."""
    down = Window.partitionBy("doc", "page").orderBy(F.desc("y"), "x")
    new = F.coalesce((F.lag("y").over(down) - F.col("y") > most_gap).cast("int"), F.lit(0))
    numbered = items.withColumn("new", new).withColumn("line_no", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.sort_array(F.collect_list(F.struct("x", "text")))
    return numbered.groupBy("doc", "page", "line_no").agg(F.array_join(F.transform(cells, lambda c: c["text"]), " ").alias("text"), F.min("x").alias("x"), F.max("y").alias("y"))


def gaps(values: DataFrame, least: float, *keys: str) -> DataFrame:
    """Groups of one-dimensional values with gaps of ``least`` or more between them: first, last and count."""
    order = Window.partitionBy(*keys).orderBy("x")
    new = F.coalesce((F.col("x") - F.lag("x").over(order) >= least).cast("int"), F.lit(0))
    grouped = values.withColumn("new", new).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "group").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.count(F.lit(1)).alias("n"))


def _touch(a: str, b: str, gap: float) -> Column:
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x0") - gap <= c(b, "x1")) & (c(b, "x0") - gap <= c(a, "x1")) & (c(a, "y0") - gap <= c(b, "y1")) & (c(b, "y0") - gap <= c(a, "y1"))


def merge_boxes(boxes: DataFrame, gap: float = 8.0, least_side: float = 40.0, least_paths: int = 8, cell: float = 64.0) -> DataFrame:
    """Boxes (doc, page, box, x0, y0, x1, y1) that touch within ``gap``, merged; small and sparse regions go.

    Boxes that no other reaches in x are done at once: what merges elsewhere stays within its own run of boxes.  Neighbours of
    the rest are found over grid cells, so only boxes that share a cell meet.  A round joins whole components of touching
    regions; rounds repeat until no two regions touch, as the reach of a merged region is that of its outline.
    """
    at = ["doc", "page", "id"]
    along = Window.partitionBy("doc", "page").orderBy("x0", "x1", "id")
    whole = boxes.select("doc", "page", F.col("box").alias("id"), "x0", "y0", "x1", "y1", F.lit(1).cast("long").alias("paths"))
    reached = F.coalesce(F.col("x0") - gap <= F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    told = whole.withColumn("_reached", reached)
    told = cut(told.withColumn("_alone", ~F.col("_reached") & ~F.coalesce(F.lead("_reached").over(along), F.lit(False))).drop("_reached"))
    alone, regions = told.where("_alone").drop("_alone"), told.where("NOT _alone").drop("_alone")
    before = -1
    while True:
        regions = cut(regions)
        now = regions.count()
        if now == before:
            break
        before = now
        span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - gap) / cell), F.floor((F.col(hi) + gap) / cell)))
        cells = regions.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
        a, b = cells.alias("a"), cells.alias("b")
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("doc", "page", "cx", "cy")]
        touching = a.join(b, [*same, F.col("b.id") < F.col("a.id"), _touch("a", "b", gap)])
        edges = touching.select(*(F.struct(*(F.col(f"{t}.{k}").alias(k) for k in at)).alias(n) for t, n in (("a", "u"), ("b", "v"))))
        to = components(edges).select(*(F.col(f"node.{k}").alias(k) for k in at), F.col("label.id").alias("to"))
        joined = regions.join(to, at, "left").withColumn("id", F.coalesce("to", "id"))
        regions = joined.groupBy(at).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("paths").alias("paths"))
    return regions.select(alone.columns).unionByName(alone).where((F.col("x1") - F.col("x0") >= least_side) & (F.col("y1") - F.col("y0") >= least_side) & (F.col("paths") >= least_paths))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes."""
    c = lambda t, n: F.col(f"{t}.{n}")
    side = lambda n: F.greatest(F.least(c(a, f"{n}1"), c(b, f"{n}1")) - F.greatest(c(a, f"{n}0"), c(b, f"{n}0")), F.lit(0.0))
    area = lambda t: (c(t, "x1") - c(t, "x0")) * (c(t, "y1") - c(t, "y0"))
    inter = side("x") * side("y")
    return F.when(area(a) + area(b) - inter > 0, inter / (area(a) + area(b) - inter)).otherwise(0.0)


def without_duplicates(regions: DataFrame, rasters: DataFrame, share: float = 0.5) -> DataFrame:
    """Regions that no raster image of their page covers by ``share``."""
    a, b = regions.alias("a"), rasters.alias("b")
    return a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (overlap("a", "b") >= share), "left_anti")


def title_events(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """Where each section's title stands: equal folded text, the first such line."""
    from loomspan.functions.text import fold

    at = lines.withColumn("key", fold(F.col("text"))).groupBy("doc", "key").agg(F.min(F.struct("page", "y")).alias("at"))
    return sections.withColumn("key", fold(F.col("title"))).join(at, ["doc", "key"]).select("doc", "section", "at.page", "at.y")


def nearest_line(images: DataFrame, lines: DataFrame) -> DataFrame:
    """The last line at or before each image in reading order."""
    from loomspan.operators.documents import active_section

    return active_section(lines.select("doc", "page", "y", F.col("line_no").cast("long").alias("section")), images).withColumnRenamed("section", "line_no")


def gallery(images: DataFrame, least_side: int = 96, most: int = 64) -> DataFrame:
    """Distinct images of a document, charts first and always kept, others from ``least_side`` on and the first ``most``;
    ``repeated`` marks pictures that came back; of images at one place the chart comes first, then the lesser kind, width, height and
    source (F9).  ``images`` has doc, pos, kind, w, h and src."""
    chart = F.coalesce(F.col("kind") == "grid", F.lit(False))
    large = images.where(F.col("src").isNotNull() & (chart | (F.least("w", "h") >= least_side)))
    # images at one place have an order too: charts first, then by kind, size and source
    once = large.groupBy("doc", "w", "h", "src").agg(F.min(F.struct("pos", (~chart).alias("plain"), "kind")).alias("i"), F.count(F.lit(1)).alias("n")).select("doc", "i.pos", "i.kind", "w", "h", "src", "n")
    grid = F.coalesce(F.col("kind") == "grid", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("doc", grid).orderBy("pos", "kind", "w", "h", "src"))
    return once.withColumn("repeated", ~grid & (F.col("n") > 1)).withColumn("rank", rank).where(grid | (F.col("rank") <= most)).drop("n", "rank")


def supply_heading(lines: DataFrame, is_heading: Column, is_supply: Column, least: int = 2, reach: int = 8) -> DataFrame:
    """Headings with at least two supply lines among the next eight of their page."""
    after = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(1, reach)
    return lines.withColumn("heading", is_heading & (F.sum(is_supply.cast("int")).over(after) >= least)).where("heading").drop("heading")


def chart_page(pages: DataFrame, hint: str, short: int = 600) -> DataFrame:
    """First page after the first that holds a hint and is short."""
    return pages.where((F.col("page") > 1) & F.col("text").rlike(hint) & (F.length("text") < short)).groupBy("doc").agg(F.min("page").alias("page"))


def chart_repeats(text: Column, pattern: str) -> Column:
    """First captured number of repeats."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
