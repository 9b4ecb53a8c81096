"""Putting a document together from its parts: sections of charts at their places, images next to the steps they belong to,
glossaries set in columns (inventory C27, L25, L45).

Everything is joins, sums and windows a document; only two neighbours at a time are compared, so no text is gathered.  Images are
placed by 16 bytes of hash a line, so what is written and moved does not depend on how long lines are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.lineage import cut

# Lines an image looks back over, lines on either side that tell how well a step fits, pages a place is carried on.
LOOK_BACK, AROUND, CARRY_PAGES, LEAST_KEY = 80, 3, 1, 3
# Fixed values of glossaries in columns: edges that count as one, how far apart anchors stand, the longest key, votes, entries.
SAME_EDGE, ANCHOR_GAP, LONGEST_KEY, LEAST_VOTES, LEAST_SHARE, LEAST_ENTRIES = 4.0, 60.0, 40, 2, 0.3, 2


def renumber(rows: DataFrame, key: str, order: list[str], name: str = "position") -> DataFrame:
    """``rows`` numbered from 0 within ``key`` by ``order``, also where one key has more rows than a task holds.

    Rows are dealt by ranges and written once; each partition counts its own, and the counts before it (one row for a key
    and partition) are added.
    """
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    held = cut(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_at")) - 1
    numbered = held.withColumn("_own", own).join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return numbered.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_at", "_own", "_key", "_of", "_before")


def promote_grids(sections: DataFrame, anchors: DataFrame, grids: DataFrame) -> DataFrame:
    """Sections of a document with each grid as a section of its own: doc, position, section (id), kind, grid.

    ``sections`` has doc, position, section and kind; ``anchors`` doc, section, page and y: where a section's title stands;
    ``grids`` doc, grid, page and y.  A grid goes right after the section that is active at its place, the last one whose title
    is above it or on a page before; grids of one section in reading order, those before the first title last of all.
    """
    down = lambda y: -F.coalesce(F.col(y), F.lit(0.0))
    titles = anchors.join(sections.select("doc", "section", F.col("position").alias("_after")), ["doc", "section"]).select("doc", "page", down("y").alias("_down"), F.lit(0).alias("_grid"), "_after", F.lit(None).cast(dict(grids.dtypes)["grid"]).alias("grid"))
    places = grids.select("doc", "page", down("y").alias("_down"), F.lit(1).alias("_grid"), F.lit(None).cast(dict(sections.dtypes)["position"]).alias("_after"), "grid")
    # of titles at one place the later section is the active one
    so_far = Window.partitionBy("doc").orderBy("page", "_down", "_grid", "_after").rowsBetween(Window.unboundedPreceding, 0)
    placed = titles.unionByName(places).withColumn("_after", F.last("_after", ignorenulls=True).over(so_far)).where("_grid = 1")
    kind = dict(sections.dtypes)["section"]
    inserts = placed.select("doc", F.col("_after").isNull().cast("int").alias("_last"), "_after", F.lit(1).alias("_grid"), "page", "_down", F.lit(None).cast(kind).alias("section"), F.lit("chart").alias("kind"), "grid")
    own = sections.select("doc", F.lit(0).alias("_last"), F.col("position").alias("_after"), F.lit(0).alias("_grid"), F.lit(None).cast(dict(grids.dtypes)["page"]).alias("page"), F.lit(None).cast("double").alias("_down"), "section", "kind", F.lit(None).cast(dict(grids.dtypes)["grid"]).alias("grid"))
    ordered = renumber(own.unionByName(inserts), "doc", ["_last", "_after", "_grid", "page", "_down", "grid"])
    return ordered.select("doc", "position", "section", "kind", "grid")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _folded(text: Column) -> Column:
    """Without words that hold a digit."""
    return F.array_join(F.filter(F.split(_normal(text), " "), lambda w: ~w.rlike("[0-9]")), " ")


def place_images(lines: DataFrame, steps: DataFrame, anchors: DataFrame, images: DataFrame) -> DataFrame:
    """The step each image belongs to: doc, image, section, step, by (C27); null where it is left for the gallery.

    ``lines`` has doc, page, line_no, y and text; ``steps`` doc, section, step (their order) and line: one row for each line a step
    was made of; ``anchors`` doc, section, page and y of titles; ``images`` doc, image, page, y and, if they have it, repeated.

    Three passes, each over what the one before left.  ``line``: the nearest line above on the page is one of a step, word for
    word.  ``folded``: going back over at most 80 lines, the first line that is one of a step once words with digits are
    dropped; not on the first page.  ``carried``: the place of the last image placed, on this page or the one before.  Where
    several steps have the line, that with the longest run of neighbouring lines of its own wins, then one of the active
    section, then the first.
    """
    keep = ~F.coalesce(F.col("repeated"), F.lit(False)) if "repeated" in images.columns else F.lit(True)
    top = F.coalesce(F.col("y"), F.lit(0.0))
    # the active section: the last title at or before an image's place; titles and images are merged in reading order
    titles = anchors.select("doc", F.col("page"), (-top).alias("_down"), F.lit(0).alias("_side"), F.col("section").alias("active"), F.lit(None).cast(dict(images.dtypes)["image"]).alias("image"), F.lit(None).cast("double").alias("top"))
    places = images.where(keep).select("doc", "page", (-top).alias("_down"), F.lit(1).alias("_side"), F.lit(None).cast(dict(anchors.dtypes)["section"]).alias("active"), "image", top.cast("double").alias("top"))
    so_far = Window.partitionBy("doc").orderBy("page", "_down", "_side", "active").rowsBetween(Window.unboundedPreceding, 0)
    asked = cut(titles.unionByName(places).withColumn("active", F.last("active", ignorenulls=True).over(so_far)).where("_side = 1").select("doc", "image", "page", "top", "active"))

    flat = _marked_lines(lines, _normal, 1)
    above = asked.join(flat.select("doc", "page", "y", "mark", "pos", "long"), ["doc", "page"])
    nearest = above.where(F.col("y") >= F.col("top")).groupBy("doc", "image", "active").agg(F.min_by(F.struct("mark", "pos", "long"), F.struct("y", -F.col("pos"))).alias("l")).where("l.long").select("doc", "image", "active", "l.mark", "l.pos")
    first = cut(_best_steps(nearest, flat, _marked_steps(steps, _normal)))
    left = cut(asked.join(first.select("doc", "image"), ["doc", "image"], "left_anti").where("page > 0"))
    placed = first.withColumn("by", F.lit("line"))
    if not left.isEmpty():
        flat, own = _marked_lines(lines, _folded, LEAST_KEY), _marked_steps(steps, _folded)
        # where going back starts: the first line below the image on its page, else the end of the last page up to that one
        below = left.join(flat.select("doc", "page", "y", "pos"), ["doc", "page"]).where(F.col("y") < F.col("top") - 1).groupBy("doc", "image").agg(F.min("pos").alias("start"))
        so_many = flat.groupBy("doc", "page").agg((F.max("pos") + 1).alias("end")).select("doc", "page", F.lit(0).alias("_side"), "end", F.lit(None).cast(dict(images.dtypes)["image"]).alias("image"))
        asks = left.select("doc", "page", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("end"), "image")
        up_to = Window.partitionBy("doc").orderBy("page", "_side").rowsBetween(Window.unboundedPreceding, 0)
        ends = so_many.unionByName(asks).withColumn("end", F.coalesce(F.max("end").over(up_to), F.lit(0))).where("_side = 1").select("doc", "image", "end")
        starts = left.join(below, ["doc", "image"], "left").join(ends, ["doc", "image"]).withColumn("start", F.coalesce("start", "end"))
        back = starts.withColumn("pos", F.explode(F.sequence(F.col("start") - LOOK_BACK, F.col("start") - 1))).join(flat.where("long").select("doc", "pos", "mark"), ["doc", "pos"])
        held = back.join(own.select("doc", "mark").distinct(), ["doc", "mark"], "left_semi")
        last = held.groupBy("doc", "image", "active").agg(F.max_by("mark", "pos").alias("mark"), F.max("pos").alias("pos"))
        placed = placed.unionByName(cut(_best_steps(last, flat, own)).withColumn("by", F.lit("folded")))
    all_of = images.select("doc", "image", "page", top.alias("top"), keep.alias("keep")).join(placed, ["doc", "image"], "left")
    return _carry_on(all_of)


def _mark(text: Column) -> Column:
    """16 bytes of a text's SHA-256: what tells whether two texts are the same, whatever their length."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _marked_lines(lines: DataFrame, form: Callable[[Column], Column], least: int) -> DataFrame:
    """doc, page, y, pos (place in the document from 0), mark and long (whether the text has ``least`` characters), written once.

    Lines are numbered within their page, and pages by the lines on those before, so only small rows are moved.
    """
    said = form(F.col("text"))
    own = F.row_number().over(Window.partitionBy("doc", "page").orderBy("line_no"))
    rows = lines.select("doc", "page", "line_no", F.coalesce("y", F.lit(0.0)).alias("y"), _mark(said).alias("mark"), (F.length(said) >= least).alias("long")).withColumn("_own", own).drop("line_no")
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = lines.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("_n")).select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(pages, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")))
    return cut(placed.select("doc", "page", "y", (F.col("_before") + F.col("_own") - 1).cast("long").alias("pos"), "mark", "long"))


def _marked_steps(steps: DataFrame, form: Callable[[Column], Column]) -> DataFrame:
    """doc, section, step and mark: one row for each text a step was made of."""
    return steps.select("doc", "section", "step", _mark(form(F.col("line"))).alias("mark"))


def _best_steps(lines: DataFrame, flat: DataFrame, own: DataFrame) -> DataFrame:
    """doc, image, section, step: of the steps that have the line of each image (doc, image, active, pos, mark) the one with the
    longest run of neighbours, then one of the active section, then the first.

    Steps made of the same lines have the same runs, so of those only the first is compared, beside the ones of the active
    section; copies of a text do not meet each other.
    """
    near = F.explode(F.sequence(F.lit(-AROUND), F.lit(AROUND)))
    around = lines.select("doc", "image", "pos", near.alias("off")).withColumn("pos", F.col("pos") + F.col("off"))
    context = around.join(flat.select("doc", "pos", F.col("mark").alias("_text")), ["doc", "pos"]).groupBy("doc", "image").agg(F.sort_array(F.collect_list(F.struct("off", "_text"))).alias("_near"))
    sets = own.groupBy("doc", "section", "step").agg(F.sort_array(F.collect_set("mark")).alias("_made"))
    kinds = sets.groupBy("doc", "_made").agg(F.min(F.struct("section", "step")).alias("s"))
    some = lines.join(kinds.select("doc", "s", "_made", F.explode("_made").alias("mark")), ["doc", "mark"]).select("doc", "image", "active", "s", "_made")
    active = sets.select("doc", F.col("section").alias("active"), F.struct("section", "step").alias("s"), "_made")
    theirs = lines.join(active, ["doc", "active"]).where(F.array_contains("_made", F.col("mark"))).select("doc", "image", "active", "s", "_made")
    # the run around the line itself: as far as neighbours are of the step, on either side
    ours = F.transform(F.filter("_near", lambda n: F.array_contains("_made", n["_text"])), lambda n: n["off"])
    side = lambda by: F.aggregate(F.sequence(F.lit(1), F.lit(AROUND)), F.lit(0), lambda n, k: F.when((n == k - 1) & F.array_contains("_ours", k * by), k).otherwise(n))
    scored = some.unionByName(theirs).join(context, ["doc", "image"]).withColumn("_ours", ours).withColumn("run", side(1) + side(-1))
    key = F.struct((-F.col("run")).alias("run"), (~F.coalesce(F.col("s.section") == F.col("active"), F.lit(False))).alias("other"), "s.section", "s.step")
    return scored.groupBy("doc", "image").agg(F.min(key).alias("k")).select("doc", "image", "k.section", "k.step")


def _carry_on(images: DataFrame) -> DataFrame:
    """Images without a place of their own take that of the last placed one; a chain of them may go on page by page."""
    order = Window.partitionBy("doc").orderBy("page", F.desc("top"), "image")
    # between two placed images pages may rise by one at a time only: a wider step, counting carried images too, ends the chain
    waiting = images.where(F.col("by").isNotNull() | (F.col("keep") & (F.col("page") > 0)))
    stepped = waiting.withColumn("_step", F.col("page") - F.lag("page").over(order))
    broken = stepped.withColumn("_chain", F.sum((F.col("by").isNotNull() | (F.col("_step") > CARRY_PAGES)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = Window.partitionBy("doc", "_chain").orderBy("page", F.desc("top"), "image").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.struct("by", "section", "step")).over(head)
    told = broken.withColumn("_f", first).select("doc", "image", F.coalesce("section", F.col("_f.section")).alias("section"), F.coalesce("step", F.col("_f.step")).alias("step"), F.when(F.col("by").isNotNull(), F.col("by")).when(F.col("_f.by").isNotNull(), "carried").alias("by"))
    return images.select("doc", "image").join(told, ["doc", "image"], "left")


def column_glossary(cells: DataFrame) -> DataFrame:
    """Keys and meanings of glossaries set in columns: doc, entry (in order), line_no, key, meaning.

    ``cells`` has doc, line_no, x and text.  Lines begin at one of two left edges, the most frequent and the most frequent one at a
    distance; the column of meanings right of an edge is where most of its lines have a later cell behind a short key.  A line
    with cells at both is an entry; one that begins at the column goes on with the meaning before it, unless that ended a
    sentence or other text came between.  A document with fewer than two entries has none.
    """
    cells = cells.where(F.trim("text") != "")
    line = Window.partitionBy("doc", "line_no").orderBy("x", "text")
    ranked = cells.withColumn("n", F.row_number().over(line)).withColumn("left", F.first("x").over(line)).withColumn("bin", F.round(F.col("x") / SAME_EDGE))
    same = lambda a, b: F.abs(a - b) <= SAME_EDGE
    edges = ranked.where("n = 1").groupBy("doc", "bin").agg(F.count(F.lit(1)).alias("votes"), F.min("x").alias("edge"))
    first = edges.groupBy("doc").agg(F.max_by("edge", F.struct("votes", -F.col("edge"))).alias("edge"))
    other = edges.join(first.withColumnRenamed("edge", "best"), "doc").where(F.abs(F.col("edge") - F.col("best")) >= ANCHOR_GAP)
    second = other.groupBy("doc").agg(F.max_by("edge", F.struct("votes", -F.col("edge"))).alias("edge"))
    lefts = first.unionByName(second)
    said = F.trim(F.regexp_replace(F.array_join(F.collect_list("text").over(line.rowsBetween(Window.unboundedPreceding, -1)), " "), r"\s{2,}", " "))
    later = ranked.withColumn("key", said).where(F.col("n") > 1)
    votes = later.where(F.length("key") <= LONGEST_KEY).join(lefts, "doc").where(same(F.col("left"), F.col("edge"))).groupBy("doc", "edge", "bin").agg(F.count_distinct("line_no").alias("votes"), F.min("x").alias("column"))
    many = ranked.where("n = 1").join(lefts, "doc").where(same(F.col("left"), F.col("edge"))).groupBy("doc", "edge").agg(F.count(F.lit(1)).alias("lines"))
    found = votes.groupBy("doc", "edge").agg(F.max(F.struct("votes", (-F.col("column")).alias("c"))).alias("m")).join(many, ["doc", "edge"])
    columns = found.select("doc", "edge", (-F.col("m.c")).alias("column"), F.col("m.votes").alias("votes"), "lines").where((F.col("column") > F.col("edge") + 2) & (F.col("votes") >= LEAST_VOTES) & (F.col("votes") >= F.col("lines") * LEAST_SHARE)).select("doc", "edge", "column")
    whole = F.trim(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " "), r"\s{2,}", " "))
    # cells at or right of the column are the meaning
    split = ranked.join(columns, "doc").where(same(F.col("left"), F.col("edge")))
    at = F.min(F.when((F.col("n") > 1) & same(F.col("x"), F.col("column")), F.col("x"))).over(Window.partitionBy("doc", "line_no", "edge"))
    side = split.withColumn("at", at).where("at IS NOT NULL")
    part = lambda c: F.trim(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("x", "text")))), lambda s: s["text"]), " "), r"\s{2,}", " "))
    entries = side.groupBy("doc", "line_no").agg(part(F.col("x") < F.col("at")).alias("key"), part(F.col("x") >= F.col("at")).alias("meaning")).where("key <> ''")
    begins = ranked.where("n = 1").join(columns, "doc").where(same(F.col("left"), F.col("column"))).select("doc", "line_no").distinct().withColumn("goes_on", F.lit(True))
    lines = ranked.groupBy("doc", "line_no").agg(whole.alias("text")).join(columns.select("doc").distinct(), "doc", "left_semi")
    told = lines.join(entries, ["doc", "line_no"], "left").join(begins, ["doc", "line_no"], "left").withColumn("text", F.coalesce("meaning", "text"))
    order = Window.partitionBy("doc").orderBy("line_no")
    ended = F.coalesce(F.lag("text").over(order).rlike(r"[.!?]\s*$"), F.lit(True))
    opens = F.col("key").isNotNull() | F.col("goes_on").isNull() | ended
    blocks = told.withColumn("_block", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ")
    out = blocks.groupBy("doc", "_block").agg(F.max("key").alias("key"), F.min("line_no").alias("line_no"), joined.alias("meaning")).where("key IS NOT NULL")
    enough = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc"))).where(F.col("_n") >= LEAST_ENTRIES)
    return enough.withColumn("entry", F.row_number().over(Window.partitionBy("doc").orderBy("line_no"))).select("doc", "entry", "line_no", "key", "meaning")
