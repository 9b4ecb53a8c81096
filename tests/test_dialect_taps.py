"""Tokens, restored titles, nested documents, and taps on the current step."""

import random
from datetime import datetime, timedelta

import pytest

from loomspan.operators import dialect
from loomspan.streaming import taps
from tests.test_timer import fed, rocks  # noqa: F401


def short(tokens):
    return [(t["type"], t["text"] if t["values"] is None else "|".join(t["values"])) for t in tokens]


@pytest.mark.parametrize(
    ("text", "counts", "keys", "want"),
    [
        ("Cast on {{0}} sts, k2tog", [["80", "90"]], ["k2tog", "k", "sts"], [("text", "Cast on "), ("count", "80|90"), ("text", " "), ("abbr", "sts"), ("text", ", "), ("abbr", "k2tog")]),
        ("{{0}}{{1}} x", [["", " "], ["3"]], [], [("count", "3"), ("text", " x")]),
        ("{{7}} {{a}} k2", [], ["k"], [("text", " {{a}} k2")]),
        ("M1 M1L (M1)", [], ["M1", "M1L"], [("abbr", "M1"), ("text", " "), ("abbr", "M1L"), ("text", " ("), ("abbr", "M1"), ("text", ")")]),
        ("", [], ["k"], []),
        ("ék k", [], ["k", ""], [("text", "ék "), ("abbr", "k")]),
    ],
)
def test_tokens(text, counts, keys, want):
    assert short(dialect.line_tokens(text, counts, keys)) == want


def test_tokens_of_a_table_by_the_abbreviations_of_each_document(spark):
    lines = spark.createDataFrame([("a", "k yo", None), ("b", "k {{0}}", [["2", "3"]]), ("c", None, None)], "doc string, t string, c array<array<string>>")
    keys = spark.createDataFrame([("a", "yo"), ("b", "k"), ("b", "")], "doc string, abbreviation string")
    got = {r["doc"]: short([t.asDict() for t in r["tokens"]]) for r in dialect.tokenized(lines, keys).collect()}
    assert got == {"a": [("text", "k "), ("abbr", "yo")], "b": [("abbr", "k"), ("text", " "), ("count", "2|3")], "c": []}
    assert {r["doc"]: len(r["tokens"]) for r in dialect.tokenized(lines).collect()} == {"a": 1, "b": 2, "c": 0}


def test_spaced_titles_find_their_words(spark):
    titles = [("a", "T H E  L A C E", "The Lace"), ("b", "T H E L A C E", None), ("c", "T H E L A C E", "Other"), ("d", "The Lace", "x"), ("e", "A B C D", None), ("f", None, None)]
    lines = [("b", 0, 0, "T H E L A C E"), ("b", 0, 1, "Welcome to: The Lace!"), ("b", 0, 2, "the lace"), ("c", 1, 0, "(the-lace) shawl"), ("e", 0, 0, "ab c")]
    got = dialect.restored_titles(spark.createDataFrame(titles, "doc string, title string, meta string"), spark.createDataFrame(lines, "doc string, page int, line_no int, text string")).collect()
    assert {r["doc"]: r["restored"] for r in got} == {"a": "The Lace", "b": "The Lace", "c": "the-lace", "d": "The Lace", "e": "ABCD", "f": None}


def test_nested_documents(spark):
    text = "---\ntitle: My: Shawl\nAuthor: Ana\n---\n# Ignored\nintro line\n## Body [work]\n> mind the gap\nRow 1: knit\n- item\n![x](a.png)\n\n## Empty\n## Edge\n| a | b |\nrepeat 3 times"
    docs = [("a", text), ("b", "# Only a title"), ("c", None), ("d", "---\nno end: x\nstill front"), ("e", "text\n---\nmore")]
    got = {r["doc"]: r for r in dialect.nested_documents(spark.createDataFrame(docs, "doc string, text string")).collect()}
    a = got["a"]
    assert a["meta"] == {"title": "My: Shawl", "author": "Ana"} and a["title"] == "My: Shawl"
    told = [(s["title"], s["kind"], [(x["type"], x["t"]) for x in s["steps"]], s["images"]) for s in a["sections"]]
    assert told == [
        (None, None, [("text", "intro line")], []), ("Body", "work", [("note", "mind the gap"), ("row", "Row 1: knit"), ("bullet", "item")], ["a.png"]), ("Empty", None, [], []), ("Edge", None, [("table", "| a | b |"), ("repeat", "repeat 3 times")], []),
    ]
    assert (got["b"]["title"], got["b"]["sections"]) == ("Only a title", []) and got["c"]["sections"] == []
    assert got["d"]["meta"] == {"no end": "x"} and len(got["e"]["sections"][0]["steps"]) == 3


T0 = datetime(2026, 3, 1)
TAPS = "project_id long, tap_id string, step_id string, delta int, at timestamp"
STEPS = "project_id long, position int, step_id string, total int"


def test_taps_apply_to_the_current_step_only(spark):
    steps = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", 2), (1, 2, "c", 0), (2, 0, "a", 1)], STEPS)
    rows = ["b", "a", "a", "b", "b-", "b-", "b", "b", "c", "x"]
    tapped = [(1, f"t{i:02}", s[0], -1 if s.endswith("-") else None, T0 + timedelta(seconds=i)) for i, s in enumerate(rows)]
    tapped += [(1, "t01", "a", None, T0 + timedelta(seconds=50)), (9, "u", "a", 1, T0), (None, None, "a", 1, T0)]
    got = taps.replay_taps(spark.createDataFrame(tapped, TAPS), steps).orderBy("tap_id").collect()
    assert [(r["tap_id"], r["step_id"], r["count"], r["done"]) for r in got] == [("t01", "a", 1, True), ("t03", "b", 1, False), ("t04", "b", 0, False), ("t05", "b", 0, False), ("t06", "b", 1, False), ("t07", "b", 2, True), ("t08", "c", 0, True)]


def test_tap_stream_equals_the_replay_across_restarts(spark, tmp_path, rocks):  # noqa: F811
    rng = random.Random(3)
    steps = spark.createDataFrame([(p, i, f"s{i}", rng.choice([None, 2, 5])) for p in range(3) for i in range(12)], STEPS)
    rows = [(rng.randrange(3), f"t{i:03}", f"s{min(11, i // 20 + rng.randrange(3))}", rng.choice([1, 1, 1, -1]), T0 + timedelta(seconds=i)) for i in range(240)]
    got = fed(spark, tmp_path, [rows[:90], rows[60:160], rows[160:]], TAPS, lambda s: taps.tap_stream(s, steps))
    want = [tuple(r) for r in taps.replay_taps(spark.createDataFrame(rows, TAPS), steps).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10
