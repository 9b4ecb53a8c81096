"""Positioned text of pages: ink profiles and gutters, cells of rows, columns, and lines read column by column (inventory L30,
L31, L33).

Profiles, rows and cells are sums and windows a page; only the merging of column starts, which goes on until nothing
changes, runs a small loop over one page's cells at a time, while sorted pages stream through a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A gutter's width and the least length of what it parts; rows and cells; columns.
GUTTER, LEAST_STRIP = 48, 80
ROW_TOLERANCE, CELL_GAP = 2.5, 18.0
CLUSTER_GAP, LEAST_WIDTH, LEAST_CELLS, LEAST_SHARED_ROWS, LEAST_COLUMNS = 40.0, 60.0, 3, 2, 3
WIDE, LEAST_PAGE_CELLS = 0.55, 8


def strips(intervals: DataFrame, keys: tuple[str, ...] = ("doc", "page"), gap: int = GUTTER, least: int = LEAST_STRIP, floor: int = 0) -> DataFrame:
    """What gutters part: the keys, start and end (both inclusive) of every strip of at least ``least`` units.

    ``intervals`` has x0 and x1 in whole units, x1 exclusive; a unit's density is the number of intervals over it, and a gutter
    is a run of ``gap`` units or more, no denser than ``floor``.  The profile is the running total of a difference array: one
    row where an interval begins or ends, whatever its length.
    """
    turns = intervals.where("x1 > x0").select(*keys, F.explode(F.array(F.struct(F.col("x0").cast("long").alias("x"), F.lit(1).alias("by")), F.struct(F.col("x1").cast("long").alias("x"), F.lit(-1).alias("by")))).alias("t"))
    along = Window.partitionBy(*keys).orderBy("x")
    steps = turns.groupBy(*keys, F.col("t.x").alias("x")).agg(F.sum("t.by").alias("by"))
    profile = steps.select(*keys, "x", F.lead("x").over(along).alias("until"), F.sum("by").over(along).alias("density"))
    inked = profile.where((F.col("density") > floor) & F.col("until").isNotNull())
    # neighbours with ink, parted where the white between them is wide enough
    new = F.coalesce((F.col("x") - F.lag("until").over(along) >= gap).cast("int"), F.lit(1))
    numbered = inked.withColumn("_new", new).withColumn("_strip", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*keys, "_strip").agg(F.min("x").alias("start"), (F.max("until") - 1).alias("end"))
    return found.where(F.col("end") - F.col("start") + 1 >= least).drop("_strip")


def cells_of(glyphs: DataFrame, tolerance: float = ROW_TOLERANCE, gap: float = CELL_GAP) -> DataFrame:
    """Cells of glyph runs (doc, page, x, y, w, size, text): doc, page, row, cell, x, end_x, y, size, text.

    A row ends where the next run, from the top, lies more than ``tolerance`` below the row's neighbour; a cell where white of more than
    ``gap`` follows what has been inked so far.  A run printed twice at one place counts once.
    """
    page = Window.partitionBy("doc", "page").orderBy(F.desc("y"), "x")
    drop = F.lag("y").over(page) - F.col("y")
    rows = glyphs.withColumn("row", F.sum(F.coalesce((drop > tolerance).cast("int"), F.lit(1))).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    row = Window.partitionBy("doc", "page", "row").orderBy("x", "text")
    twice = F.coalesce((F.lag("text").over(row) == F.col("text")) & (F.col("x") - F.lag("x").over(row) < 0.6), F.lit(False))
    rows = rows.withColumn("_twice", twice).where("NOT _twice").drop("_twice")
    inked = F.max(F.col("x") + F.coalesce("w", F.lit(0.0))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(((F.col("x") - inked > gap) & (F.trim("text") != "")).cast("int"), F.lit(1))
    cut = rows.withColumn("_new", new).withColumn("cell", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), "")
    cells = cut.groupBy("doc", "page", "row", "cell").agg(F.min("x").alias("x"), F.max(F.col("x") + F.coalesce("w", F.lit(0.0))).alias("end_x"), F.max("y").alias("y"), F.max("size").alias("size"), said.alias("text"))
    return cells.where(F.trim("text") != "")


def column_starts(x: np.ndarray, end: np.ndarray, y: np.ndarray, width: float) -> list[float]:
    """Left edges of the columns of one page, none if there are fewer than three.

    Cells over more than 0.55 of the page are left out.  Edges no further apart than CLUSTER_GAP are one cluster; neighbours whose
    medians are closer than LEAST_WIDTH are merged, the leftmost such pair first, until there is none.  Then columns go, one at
    a time, that are overrun from the left on more rows than they hold, or that share too few rows with another.
    """
    keep = end - x < WIDE * width
    x, end, row = x[keep], end[keep], np.round(y[keep] / ROW_TOLERANCE)
    if len(x) < LEAST_PAGE_CELLS:
        return []
    edges = np.sort(x)
    clusters = np.split(edges, np.flatnonzero(np.diff(edges) > CLUSTER_GAP) + 1)
    middle = lambda c: float(np.sort(c)[len(c) // 2])
    at = 1
    while at < len(clusters):
        if middle(clusters[at]) - middle(clusters[at - 1]) < LEAST_WIDTH:
            clusters[at - 1 : at + 1] = [np.concatenate(clusters[at - 1 : at + 1])]
            at = max(1, at - 1)  # the merged one may now be close to that on its left
        else:
            at += 1
    columns = [middle(c) for c in clusters if len(c) >= LEAST_CELLS]
    while len(columns) >= LEAST_COLUMNS:
        of = column_of(x, columns)
        held = [set(row[of == k]) for k in range(len(columns))]
        overrun = [set(row[(of < k) & (end > columns[k] + CELL_GAP)]) for k in range(len(columns))]
        bad = next((k for k in range(1, len(columns)) if len(overrun[k]) > len(held[k])), None)
        if bad is None:
            shared = [sum(any(r in held[j] for j in range(len(columns)) if j != k) for r in held[k]) for k in range(len(columns))]
            bad = next((k for k, n in enumerate(shared) if n < LEAST_SHARED_ROWS), None)
        if bad is None:
            break
        del columns[bad]
    return columns if len(columns) >= LEAST_COLUMNS else []


def column_of(x: np.ndarray, columns: list[float]) -> np.ndarray:
    """The last column that begins at or before each edge, by the cluster gap; the first for those further left."""
    return np.maximum(np.searchsorted(np.array(columns) - CLUSTER_GAP, x, "right") - 1, 0)


def _page_starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where a page begins in rows that are sorted by doc and page."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for key in ("doc", "page"):
        column = rows.column(key)
        code = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode")
        new[1:] |= np.diff(code.indices.to_numpy(zero_copy_only=False)) != 0
    return np.flatnonzero(new)


def _page_of(rows: pa.RecordBatch, at: int) -> tuple:
    return tuple(rows.column(key)[at].as_py() for key in ("doc", "page"))


def columns_of(cells: DataFrame, width: float = 595.0) -> DataFrame:
    """Cells with ``column``, from 0; null on pages of fewer than three columns.

    Cells are dealt by their page and stream by in its order, so a task holds a batch and the one page that goes on after it;
    pages are many and small, and a group each would cost more than its columns do.
    """
    schema = f"{', '.join(f'`{n}` {t}' for n, t in cells.dtypes)}, column int"

    def place(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        x, end, y = (rows.column(c).to_numpy().astype(float) for c in ("x", "end_x", "y"))
        bounds = np.append(_page_starts(rows), rows.num_rows)
        found, none = np.zeros(rows.num_rows, np.int32), np.ones(rows.num_rows, bool)
        for k in np.flatnonzero(np.diff(bounds) >= LEAST_PAGE_CELLS):
            page = slice(bounds[k], bounds[k + 1])
            starts = column_starts(x[page], end[page], y[page], width)
            if starts:
                found[page], none[page] = column_of(x[page], starts), False
        yield from rows.append_column("column", pa.array(found, pa.int32(), mask=none)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the page under way
        for b in batches:
            if not b.num_rows:
                continue
            if held and _page_of(held[-1], -1) != _page_of(b, 0):
                yield from place(held)
                held = []
            last = int(_page_starts(b)[-1])
            if last:
                yield from place([*held, b.slice(0, last)])
                held = []
            held.append(b.slice(last))
        if held:
            yield from place(held)

    return cells.repartition("doc", "page").sortWithinPartitions("doc", "page").mapInArrow(run, schema)


def lines_of_columns(cells: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Lines in reading order, column after column: doc, page, line_no, column, y, text (L30).  ``cells`` has ``column``."""
    column = F.coalesce("column", F.lit(0))
    down = Window.partitionBy("doc", "page", "_column").orderBy(F.desc("y"), "x")
    drop = F.lag("y").over(down) - F.col("y")
    # dealt by page, so that neither the columns nor the order of their lines need another shuffle
    rows = cells.repartition("doc", "page").withColumn("_column", column).withColumn("_row", F.sum(F.coalesce((drop > tolerance).cast("int"), F.lit(1))).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ")
    lines = rows.groupBy("doc", "page", "_column", "_row").agg(F.max("column").alias("column"), F.max("y").alias("y"), F.trim(F.regexp_replace(said, r"\s{2,}", " ")).alias("text"))
    order = Window.partitionBy("doc", "page").orderBy("_column", "_row")
    return lines.withColumn("line_no", F.row_number().over(order) - 1).select("doc", "page", "line_no", "column", "y", "text")


def page_lines(glyphs: DataFrame, width: float = 595.0) -> DataFrame:
    """From glyph runs to lines in reading order."""
    return lines_of_columns(columns_of(cells_of(glyphs), width))
