"""Queries of ``folds`` without SQL, over whole tables, against the plain versions."""

from collections import defaultdict

from loomspan.operators import pages, vectors
from loomspan.operators.documents import lines_of
from loomspan.plans import folds
from loomspan.plans import standins as S
from loomspan.streaming.timer import Timer
from tests.test_pages_assembly import plain_cells, plain_columns, plain_places
from tests.test_reflow_vectors import plain_fold

SF = "/root/testdata/sf0.001"


def micros(t):
    return int((t - t.replace(year=1970, month=1, day=1, hour=0, minute=0, second=0, microsecond=0)).total_seconds() * 1e6 + 0.5)


def test_timer_writes(spark):
    rows = folds.commands(spark, SF).selectExpr("owner", "unix_micros(cast(at AS timestamp)) AS at", "seq", "command", "project_id", "section_id").collect()
    by_owner = defaultdict(list)
    for r in rows:
        by_owner[r["owner"]].append(r)
    want = []
    for owner, some in by_owner.items():
        timer = Timer()
        for r in sorted(some, key=lambda r: (r["at"], r["seq"])):
            want += [(owner, *w) for w in timer.apply(r["command"], r["at"], r["seq"], r["project_id"], r["section_id"])]
    got = folds.timer_writes(spark, SF).selectExpr("owner", "line", "project_id", "section_id", "unix_micros(began)", "unix_micros(written)", "added_sec", "duration_sec").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    totals = defaultdict(int)
    for w in want:
        totals[w[0], w[1]] += w[6]
    assert {(r["owner"], r["line"]): r["duration_sec"] for r in folds.timer_journal(spark, SF).collect()} == totals


def test_folded_lines(spark):
    texts = defaultdict(list)
    for r in folds.wrapped(spark, SF).orderBy("doc", "line_no").collect():
        texts[r["doc"]].append(r["text"])
    got = defaultdict(list)
    for r in folds.folded_lines(spark, SF).orderBy("doc", "line_no").collect():
        got[r["doc"]].append(r["text"])
    assert got == {d: plain_fold(t) for d, t in texts.items()}


def test_vector_lines(spark):
    lines = lines_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "doc_id", "text").collect()
    want = sorted((r["doc"], r["line_no"], v.start, v.end, v.family, "|".join(v.values)) for r in lines for v in vectors.find_vectors(r["text"]))
    assert sorted(tuple(r) for r in folds.vector_lines(spark, SF).collect()) == want and want


def test_page_column_lines(spark):
    runs = defaultdict(list)
    for r in folds.glyphs(spark, SF).collect():
        runs[r["doc"], r["page"]].append((r["x"], r["y"], r["w"], r["text"]))
    got = defaultdict(list)
    for r in folds.page_column_lines(spark, SF).collect():
        got[r["doc"], r["page"]].append(r)
    several = 0
    for page, some in runs.items():
        cells = plain_cells(some)
        columns = plain_columns(cells, 595)
        several += bool(columns)
        want = defaultdict(list)
        for c in cells:
            want[max([k for k, s in enumerate(columns) if c["x"] >= s - pages.CLUSTER_GAP], default=0)].append(c)
        lines = []
        for k in sorted(want):
            rows = []
            for c in sorted(want[k], key=lambda c: (-c["y"], c["x"])):
                if not rows or rows[-1][-1]["y"] - c["y"] > pages.ROW_TOLERANCE:
                    rows.append([])
                rows[-1].append(c)
            lines += [(k, " ".join(c["text"] for c in sorted(row, key=lambda c: (c["x"], c["text"])))) for row in rows]
        assert [(r["column"] or 0, r["text"]) for r in sorted(got[page], key=lambda r: r["line_no"])] == lines
    assert several


def test_placed_images(spark):
    lines, steps, heads, images = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    last = defaultdict(int)
    for r in S.document_lines(spark, SF).collect():
        n, y = r["line_no"], 100_000.0 - r["line_no"]
        section = f"{r['page']}/{n // 9}"
        lines[r["doc"]].append((r["page"], n, y, r["text"]))
        steps[r["doc"]].append((section, n // 3 % 3, r["text"]))
        if n % 9 == 0:
            heads[r["doc"]].append((section, r["page"], y))
        last[r["doc"], r["page"]] = max(last[r["doc"], r["page"]], n)
    for (doc, page), n in last.items():
        images[doc].append((page, page, 100_000.0 - n // 2, False))
    got = {(r["doc"], r["image"]): (r["section"], r["step"], r["by"]) for r in folds.placed_images(spark, SF).collect()}
    want = {(d, i): p for d in lines for i, p in plain_places(lines[d], steps[d], heads[d], images[d]).items()}
    assert got == want
