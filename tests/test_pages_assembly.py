"""Gutters, cells, columns, promoted sections, placed images and column glossaries against plain loops."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import assembly, pages


def brute_strips(intervals, gap, least, floor):
    if not intervals:
        return []
    top = max(b for _, b in intervals)
    profile = [sum(a <= i < b for a, b in intervals) for i in range(top)]
    out, start, last = [], None, None
    for i, n in enumerate(profile):
        if n > floor:
            if start is not None and i - last - 1 >= gap:
                out.append((start, last))
                start = None
            start, last = i if start is None else start, i
    if start is not None:
        out.append((start, last))
    return [(a, b) for a, b in out if b - a + 1 >= least]


@pytest.mark.parametrize(("gap", "least", "floor"), [(5, 1, 0), (1, 3, 0), (8, 10, 1), (48, 80, 0)])
def test_strips_equal_a_plain_profile(spark, gap, least, floor):
    rng = random.Random(gap)
    boxes = [(d, 0, a, a + rng.randint(-2, 30)) for d in range(40) for a in (rng.randint(0, 300) for _ in range(rng.randint(0, 12)))]
    got = defaultdict(list)
    for r in pages.strips(spark.createDataFrame(boxes, "doc int, page int, x0 int, x1 int"), gap=gap, least=least, floor=floor).collect():
        got[r["doc"]].append((r["start"], r["end"]))
    for d in range(40):
        assert sorted(got[d]) == brute_strips([(a, b) for k, _, a, b in boxes if k == d and b > a], gap, least, floor)


def glyphs_of(rng, width=595):
    """Runs of a page of three columns, of one, or of scattered text."""
    kind = rng.choice(["three", "one", "scatter", "four"])
    out = []
    for r in range(rng.randint(6, 14)):
        y = 800 - 20 * r
        if kind in ("three", "four"):
            for c in range(3 if kind == "three" else 4):
                if rng.random() < 0.85:
                    x = 40 + c * (180 if kind == "three" else 130) + rng.choice([0, 0, 0, 3])
                    w = rng.choice([40, 60, 80])
                    out += [(x, y + rng.choice([0, 1]), w, f"c{c}r{r}"), (x + w + rng.choice([3, 3, 25]), y, 10.0, "z")]
        elif kind == "one":
            out.append((40.0, y, 500.0, f"r{r}"))
        else:
            out += [(rng.uniform(0, 500), y + rng.uniform(-3, 3), rng.uniform(10, 60), f"s{r}{i}") for i in range(3)]
    if out and rng.random() < 0.3:
        out.append(out[0])
    return [(float(x), float(y), float(w), t) for x, y, w, t in out]


def plain_cells(glyphs):
    rows = []
    for g in sorted(glyphs, key=lambda g: (-g[1], g[0])):
        if not rows or rows[-1][-1][1] - g[1] > pages.ROW_TOLERANCE:
            rows.append([])
        rows[-1].append(g)
    out = []
    for row in rows:
        cells, before = [], None
        for x, y, w, t in sorted(row, key=lambda g: (g[0], g[3])):
            if before and before[1] == t and x - before[0] < 0.6:
                before = (x, t)
                continue
            before = (x, t)
            if not cells or (x - cells[-1]["end"] > pages.CELL_GAP and t.strip()):
                cells.append({"x": x, "end": x + w, "y": y, "text": ""})
            c = cells[-1]
            c["text"] += t
            c["end"], c["y"] = max(c["end"], x + w), max(c["y"], y)
        reach = 0.0
        out += [c for c in cells if c["text"].strip()]
    return out


def plain_columns(cells, width):
    cells = [c for c in cells if c["end"] - c["x"] < pages.WIDE * width]
    if len(cells) < pages.LEAST_PAGE_CELLS:
        return []
    clusters = []
    for x in sorted(c["x"] for c in cells):
        if clusters and x - clusters[-1][-1] <= pages.CLUSTER_GAP:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    middle = lambda c: sorted(c)[len(c) // 2]
    while True:  # the leftmost close pair, over and over
        pair = next((i for i in range(1, len(clusters)) if middle(clusters[i]) - middle(clusters[i - 1]) < pages.LEAST_WIDTH), None)
        if pair is None:
            break
        clusters[pair - 1 : pair + 1] = [clusters[pair - 1] + clusters[pair]]
    columns = [middle(c) for c in clusters if len(c) >= pages.LEAST_CELLS]
    of = lambda x: max([k for k, c in enumerate(columns) if x >= c - pages.CLUSTER_GAP], default=0)
    row = lambda c: round(c["y"] / pages.ROW_TOLERANCE)
    while len(columns) >= 3:
        held = [{row(c) for c in cells if of(c["x"]) == k} for k in range(len(columns))]
        over = [{row(c) for c in cells if of(c["x"]) < k and c["end"] > columns[k] + pages.CELL_GAP} for k in range(len(columns))]
        bad = [k for k in range(1, len(columns)) if len(over[k]) > len(held[k])]
        bad = bad or [k for k in range(len(columns)) if sum(any(r in held[j] for j in range(len(columns)) if j != k) for r in held[k]) < pages.LEAST_SHARED_ROWS]
        if not bad:
            return columns
        del columns[bad[0]]
    return []


def test_cells_and_columns_equal_a_plain_loop(spark):
    rng = random.Random(3)
    made = {d: glyphs_of(rng) for d in range(40)}
    df = spark.createDataFrame([(d, 0, x, y, w, 10.0, t) for d, g in made.items() for x, y, w, t in g], "doc int, page int, x double, y double, w double, size double, text string")
    got, placed = defaultdict(list), defaultdict(dict)
    for r in pages.columns_of(pages.cells_of(df)).collect():
        got[r["doc"]].append((r["x"], r["end_x"], r["y"], r["text"]))
        placed[r["doc"]][r["x"], r["y"], r["text"]] = r["column"]
    several = 0
    for d, g in made.items():
        cells = plain_cells(g)
        assert sorted(got[d]) == sorted((c["x"], c["end"], c["y"], c["text"]) for c in cells)
        columns = plain_columns(cells, 595)
        several += len(columns) >= 3
        for c in cells:
            want = max([k for k, s in enumerate(columns) if c["x"] >= s - pages.CLUSTER_GAP], default=0) if columns else None
            assert placed[d][c["x"], c["y"], c["text"]] == want
    assert 5 < several < 35
    lines = pages.page_lines(df).where("doc = 0").orderBy("line_no").collect()
    order = [(r["column"] or 0, -r["y"]) for r in lines]
    assert order == sorted(order)


def test_merging_goes_on_until_nothing_is_close():
    x = np.array([0.0] * 4 + [45] * 4 + [100] * 4 + [300] * 4 + [500] * 4)
    y = np.tile(np.arange(4) * 20.0, 5)
    assert pages.column_starts(x, x + 20, y, 595.0) == [45.0, 300.0, 500.0]


# promoted sections


def test_grids_become_sections_where_they_stand(spark):
    sections = spark.createDataFrame([("d", i, s, "text") for i, s in enumerate("abc")] + [("e", 0, "x", "text")], "doc string, position int, section string, kind string")
    anchors = spark.createDataFrame([("d", "a", 0, 700.0), ("d", "b", 1, 600.0), ("d", "c", 2, 500.0)], "doc string, section string, page int, y double")
    # two at one anchor, one before the first title, one on a title's page above it, one in a document without titles
    grids = spark.createDataFrame([("d", "g2", 1, 300.0), ("d", "g1", 1, 400.0), ("d", "g0", 0, 750.0), ("d", "g3", 2, 550.0), ("d", "g4", 2, 100.0), ("e", "h", 0, 1.0)], "doc string, grid string, page int, y double")
    got = assembly.promote_grids(sections, anchors, grids).orderBy("doc", "position").collect()
    assert [(r["doc"], r["position"], r["section"] or r["grid"]) for r in got] == [
        ("d", 0, "a"), ("d", 1, "b"), ("d", 2, "g1"), ("d", 3, "g2"), ("d", 4, "g3"), ("d", 5, "c"), ("d", 6, "g4"), ("d", 7, "g0"), ("e", 0, "x"), ("e", 1, "h"),
    ]
    assert assembly.promote_grids(sections, anchors, grids.where("false")).count() == 4


def test_numbers_run_through_a_key_of_many_partitions(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("key"), (F.col("id") * 7919 % 20011).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 5), (None, 3)], "key string, v long"))
    got = defaultdict(list)
    for r in assembly.renumber(rows.repartition(6), "key", ["v"]).collect():
        got[r["key"]].append((r["v"], r["position"]))
    assert {k: [p for _, p in sorted(v)] for k, v in got.items()} == {k: list(range(len(v))) for k, v in got.items()}


# images


def plain_places(lines, steps, anchors, images):
    """One image after the other over one document's lists."""
    norm = lambda t: re.sub(r"\s+", " ", (t or "").lower()).strip()
    fold = lambda t: " ".join(w for w in norm(t).split(" ") if not re.search("[0-9]", w))
    lines = sorted(lines, key=lambda r: (r[0], r[1]))
    own = defaultdict(set), defaultdict(set)
    for section, step, line in steps:
        own[0][section, step].add(norm(line))
        own[1][section, step].add(fold(line))
    texts = [norm(r[3]) for r in lines], [fold(r[3]) for r in lines]

    def best(at, kind, active):
        scored = []
        for step, mine in own[kind].items():
            if texts[kind][at] in mine:
                run = 0
                for direction in (1, -1):
                    i = at + direction
                    while abs(i - at) <= assembly.AROUND and 0 <= i < len(lines) and texts[kind][i] in mine:
                        run, i = run + 1, i + direction
                scored.append((-run, step[0] != active, *step))
        return min(scored)[2:] if scored else None

    out, last = {}, None
    for image, page, top, repeated in sorted(images, key=lambda r: (r[1], -r[2], r[0])):
        out[image] = (None, None, None)
        if repeated:
            continue
        titles = [(p, -y, s) for s, p, y in anchors if (p, -y) <= (page, -top)]
        active = max(titles)[2] if titles else None
        above = [(lines[i][2], i) for i in range(len(lines)) if lines[i][0] == page and lines[i][2] >= top]
        place, by = None, None
        if above:
            y = min(a[0] for a in above)
            at = max(i for v, i in above if v == y)
            place, by = (best(at, 0, active) if texts[0][at] else None), "line"
        if place is None and page > 0:
            start = next((i for i in range(len(lines)) if lines[i][0] > page or (lines[i][0] == page and lines[i][2] < top - 1)), len(lines))
            for i in range(start - 1, max(-1, start - 1 - assembly.LOOK_BACK), -1):
                if len(texts[1][i]) >= assembly.LEAST_KEY and (place := best(i, 1, active)):
                    by = "folded"
                    break
            if place is None and last and 0 <= page - last[0] <= 1:
                place, by = last[1], "carried"
        if place is not None:
            out[image], last = (*place, by), (page, place)
    return out


def test_images_are_placed_as_by_a_greedy_loop(spark):
    rng = random.Random(11)
    words = ["knit row 3", "purl row 4", "turn", "Cast on 80", "repeat", "bind off 9", "x2", ""]
    tables = [[], [], [], []]
    for d in range(25):
        for page in range(4):
            for n in range(rng.randint(0, 7)):
                tables[0].append((d, page, n, 700.0 - 60 * n, rng.choice(words[: 3 if d % 5 == 0 else 8])))  # every fifth repeats few lines
        for section in range(3):
            tables[2].append((d, section, rng.randint(0, 3), rng.choice([690.0, 500.0, 100.0])))
            for step in range(rng.randint(0, 3)):
                tables[1] += [(d, section, step, rng.choice(words[:7])) for _ in range(rng.randint(1, 3))]
        tables[3] += [(d, i, rng.randint(0, 5), float(rng.randint(0, 800)), rng.random() < 0.1) for i in range(6)]
    # more lines than an image looks back over: the place is carried on from page to page, and not over a gap of two
    tables[0] += [(24, 10, 0, 700.0, "unique words")] + [(24, 10 + n // 60, n, 600.0 - n % 60, "zzz") for n in range(1, 200)]
    tables[1].append((24, 0, 9, "unique words"))
    tables[3] += [(24, 20 + i, page, top, False) for i, (page, top) in enumerate([(10, 650.0), (11, 541.0), (12, 541.0), (13, 500.0), (15, 500.0), (16, 500.0)])]
    schemas = ["doc int, page int, line_no int, y double, text string", "doc int, section int, step int, line string", "doc int, section int, page int, y double", "doc int, image int, page int, y double, repeated boolean"]
    frames = [spark.createDataFrame(t, s) for t, s in zip(tables, schemas)]
    got = {(r["doc"], r["image"]): (r["section"], r["step"], r["by"]) for r in assembly.place_images(*frames).collect()}
    want = {}
    for d in range(25):
        if not any(r[0] == d for r in tables[0]):
            continue
        of = [[r[1:] for r in t if r[0] == d] for t in tables]
        want |= {(d, i): p for i, p in plain_places(*of).items()}
    assert {k: got[k] for k in want} == want
    assert {"line", "folded", "carried", None} <= {p[2] for p in want.values()}


# glossaries


def glossary(spark, *lines):
    rows = [("d", n, float(x), t) for n, cells in enumerate(lines) for x, t in cells]
    return [(r["key"], r["meaning"]) for r in assembly.column_glossary(spark.createDataFrame(rows, "doc string, line_no int, x double, text string")).orderBy("entry").collect()]


def test_two_columns_with_wrapped_meanings(spark):
    got = glossary(
        spark, [(40, "Abbreviations of this pattern")], [(40, "k2tog"), (120, "knit two stitches together as")], [(120, "one, to the right")], [(41, "sl"), (121, "slip a stitch.")],
        [(120, "A sentence of its own")], [(40, "yo"), (70, "(twice)"), (119, "yarn over")], [(40, "Not an entry")], [(120, "nor its tail")],
    )
    assert got == [("k2tog", "knit two stitches together as one, to the right"), ("sl", "slip a stitch."), ("yo (twice)", "yarn over")]


def test_three_columns_and_two_anchors(spark):
    got = glossary(spark, [(40, "k"), (120, "knit")], [(40, "p"), (120, "purl")], [(300, "st"), (380, "stitch")], [(300, "rep"), (380, "repeat from")], [(380, "the star")], [(40, "tog"), (120, "together"), (200, "(of two)")])
    assert got == [("k", "knit"), ("p", "purl"), ("st", "stitch"), ("rep", "repeat from the star"), ("tog", "together (of two)")]


def test_prose_and_single_entries_are_no_glossary(spark):
    assert glossary(spark, [(40, "just text")], [(40, "more text")]) == []
    assert glossary(spark, [(40, "k"), (120, "knit")], [(40, "only one")], [(40, "and prose")]) == []


def test_columns_stream_page_by_page(spark):
    """Pages go on over Arrow batches, none is a group of its own, and lines need no shuffle beyond those of pages."""
    runs = [(d, p, 140.0 * k, 700.0 - 12 * r, 40.0, 10.0, f"{d}{p}{k}{r}") for d in range(3) for p in range(4) for k in range(p) for r in range(5 + d)]
    df = spark.createDataFrame(runs, "doc int, page int, x double, y double, w double, size double, text string")
    want = sorted(map(tuple, pages.page_lines(df).collect()))
    assert {r[1] for r in want if r[3] is not None} == {3}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, pages.page_lines(df).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = pages.page_lines(df)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_placing_images_writes_no_texts(spark):
    """What is written on the way depends on how many lines there are, not on how long they are; copies keep the first step."""
    import os

    lines = [(0, p, n, -float(n), f"line {chr(97 + n)} " + "long " * 2000) for p in range(20) for n in range(6)]
    df = spark.createDataFrame(lines, "doc int, page int, line_no int, y double, text string")
    steps = df.selectExpr("doc", "concat('s', lpad(page, 2, '0')) AS section", "line_no div 3 AS step", "text AS line")
    heads = df.where("line_no = 0").selectExpr("doc", "concat('s', lpad(page, 2, '0')) AS section", "page", "y")
    images = df.where("line_no = 4").selectExpr("doc", "page * 10 AS image", "page", "y")
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    written = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)
    before = written()
    got = {r["image"]: (r["section"], r["step"], r["by"]) for r in assembly.place_images(df, steps, heads, images.union(heads.selectExpr("doc", "page * 10 + 1", "page", "9.0D"))).collect()}
    assert {i: g for i, g in got.items() if i % 10 == 0} == {10 * p: (f"s{p:02d}", 1, "line") for p in range(20)}
    assert written() - before < sum(len(r[4]) for r in lines) / 10
