"""Ranked search, filter interaction audit and license scans against brute force and SQL, and their odd cases."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import audit, licenses, queries, search
from loomspan.llm.common import table

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(([r[c] for c in names] for r in got.collect()), key=repr) == sorted((list(r) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_search", "op12_filter_audit"])
def test_queries_agree_with_their_sql(spark, name):
    agrees_with_sql(spark, name)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, very long texts, repeats, ties and extra columns named like internal ones."""
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "x1", "été", "日本", "d-e", "it's", "12", "The", "end.", "MIT", "License", "$5", "ΑΒ"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = text(20000)
    body = [None, "", " \n ", "-- !!", "alpha", "ALPHA", "alpha", text(60), text(60), long, long + " tail", long, text(300), text(300) + " Mit  license", "a" * 5000]
    rows = [(i, t, None if i % 3 else "en", "s", "p", i % 2) for i, t in enumerate(body)]
    rows += [(None, "no id alpha", "", "s", None, 1), (None, "alpha", "fr", None, None, 2), (6, "alpha", "en", "s", "p", 0), (6, body[8], "fr", "s", "p", 0), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, term string, part string, rank int").cache()


def brute_search(docs, items, k):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "block", "k"), [(8 << 20, 4 << 20, 20), (300, 4000, 3), (1 << 15, 1 << 20, 5)])
def test_search_against_brute_force(spark, odd, shard, block, k):
    items = [(0, "alpha beta GAMMA"), (1, None), (2, ""), (3, "?!"), (4, "alpha"), (4, "alpha"), (None, "été 日本 日本 x1"), (5, "unknown words"), (6, "tail 12 12 12 the"), (7, " ".join(f"alpha x{i} é{i}" for i in range(3000)))]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    index = search.build_index(odd.repartition(5), shard_bytes=shard)
    got = sorted((tuple(r) for r in search.search(index, asked, k, block=block).collect()), key=repr)
    assert got == brute_search([(r["doc_id"], r["text"]) for r in odd.collect()], items, k)
    assert index.rows.where("term = ''").count() > (1 if shard < 1000 else 0)


def test_search_of_empty_tables_and_text_ids(spark, odd):
    asked = spark.createDataFrame([(1, "alpha")], "item_id int, text string")
    assert search.ranked(odd.where("false"), asked).count() == 0
    assert search.ranked(odd, asked.where("false")).count() == 0
    found = search.ranked(odd.where("text IN ('alpha', 'ALPHA', '-- !!', '')").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))), asked, 2).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, "d4"), (2, "d5")]


def test_adding_up_stops_when_the_bounds_allow_and_only_then():
    rng = np.random.default_rng(3)
    stopped = 0
    for turn in range(300):
        docs, terms_, k = int(rng.integers(1, 400)), int(rng.integers(1, 12)), int(rng.integers(1, 8))
        value, term, start, length, postings, brute = [], [], [], [], [], np.zeros(docs, np.int64)
        for t in range(terms_):
            held = rng.permutation(docs)[: int(rng.integers(1, docs + 1))]
            gains = np.sort(rng.integers(1, 50 if turn % 2 else 3, len(held)) * int(rng.integers(1, 1000)))[::-1]
            brute[held] += gains
            at = np.flatnonzero(np.diff(gains, prepend=-1))
            value += list(gains[at])
            term += [t] * len(at)
            start += list(len(postings) + at)
            length += list(np.diff(at, append=len(gains)))
            postings += list(held)
        found, scores, added = search.score_at_a_time(*(np.array(x, np.int64) for x in (value, term, start, length, postings)), docs, k, least=1, step=16)
        assert np.array_equal(scores, brute[found])
        need = np.sort(brute[brute > 0])[::-1][:k]
        assert np.array_equal(np.sort(scores)[::-1][: len(need)], need)
        assert set(np.flatnonzero((brute > 0) & (brute >= need[-1]))) <= set(found)
        stopped += added < len(postings)
    assert stopped > 20


def test_lengths_beyond_64_bits():
    n = np.array([1, 10_000_000], np.int64)
    assert search.lengths(n, 10**12, 10**15).tolist() == [75, 75 + 25 * 10_000_000 * 10**12 // 10**15]


# filter interaction audit


def brute_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1 and d is not None} for i in (0, 1))
    ids = defaultdict(list)
    for d, t, _ in docs:
        if d is not None:
            ids[t or ""].append(d)
    judged = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and any(o < d for o in ids[t])}
        judged[lang or ""].append(({f for f, bad in fails.items() if bad}, d in good, d in toxic))
    out = []
    for part, rows in judged.items():
        steps = {}
        for order in permutations("ABCDE"):
            left = list(rows)
            gone = []
            for i, f in enumerate(order):
                removed = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] for r in gone)
                left = [r for r in left if f not in r[0]]
                gone += removed
                steps["".join(order), i + 1] = [len(left), len(removed), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        worth = Counter()
        for (order, step), row in steps.items():
            worth[order[step - 1]] += row[1]
        out += [(part, order, step, *row, worth[order[step - 1]]) for (order, step), row in steps.items()]
    return sorted(out)


def test_audit_against_walking_every_order(spark, odd):
    labels = [(4, 1, None), (4, None, 1), (5, 0, 1), (9, 1, 1), (11, 1, 0), (None, 1, 1), (12, None, None), (77, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit(odd, marks).collect())
    want = brute_audit([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], labels)
    assert got == want and {r[0] for r in got} == {"", "en", "fr"} and len(got) == 1800


def test_audit_of_a_hot_text_and_of_nothing(spark, odd):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    first = audit.audit(docs, marks).where("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r["kept"], r["removed"]) for r in first] == [(1001, 1999)]
    assert audit.audit(odd.where("false"), marks).count() == 0
    assert audit.audit(docs, marks.where("false")).count() == 600


# license scans


def as_regex(markup):
    """A template as a pattern over words that each end in a space."""
    out = ""
    for m in re.finditer(r"\[\[|\]\]|<[^<>:]*:(\d+)-(\d+)>|[^\s\[\]<>]+", markup):
        if m[0] == "[[":
            out += "(?:"
        elif m[0] == "]]":
            out += ")?"
        elif m[1]:
            out += f"(?:[^ ]+ ){{{m[1]},{m[2]}}}"
        else:
            out += "".join(re.escape(w) + " " for w in PLAIN.findall(lower(m[0])))
    return re.compile(out)


def brute_places(text, templates, phrases):
    words = PLAIN.findall(lower(text))
    out = []
    for phrase, label in phrases:
        p = phrase.split()
        out += [("base", label, i, i + len(p)) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    for label, markup in templates:
        rule = as_regex(markup)
        for i in range(len(words)):
            ends = [j for j in range(i + 1, len(words) + 1) if rule.fullmatch("".join(w + " " for w in words[i:j]))]
            out += [("template", label, i, max(ends))] if ends else []
    return sorted(out)


def test_automata_against_patterns_on_random_words(spark):
    templates = [("x", "a [[b [[c]]]] <v:1-3> d"), ("y", "b <v:0-2> c [[d <w:0-2>]]"), ("z", "[[a]] [[b]] e"), ("w", "a <v:2-2> <u:0-1> a")]
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice("aabbcde,f") for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(200, None), (201, "")]
    got = defaultdict(list)
    for r in licenses.license_places(spark.createDataFrame(data, "doc_id int, text string"), templates, [("a b", "p"), ("a a a", "q")]).collect():
        got[r["doc_id"]].append((r["kind"], r["label"], r["first_word"], r["end_word"]))
    for i, t in data:
        assert sorted(got[i]) == brute_places(t, templates, [("a b", "p"), ("a a a", "q")])


def test_templates_must_begin_with_a_word_and_be_whole():
    for bad in ("<v:1-2> a", "[[a]]", "[[a b", "a ]] b"):
        with pytest.raises((ValueError, IndexError)):
            licenses.compile_templates([("x", bad)])


def full(label, owner="Jane Q. Public and others"):
    markup = max((m for name, m in licenses.TEMPLATES if name == label), key=len)
    return re.sub(r"<[^>]*>", owner, markup).replace("[[", "").replace("]]", "").upper()


def test_whole_licenses_are_accepted_and_changed_ones_are_not(spark):
    names = sorted({name for name, _ in licenses.TEMPLATES})
    rows = [(n, f"Intro here. {full(n)} The end.") for n in names] + [(f"{n} broken", full(n).replace("SOFTWARE", "HARDWARE", 1).replace(" UNDER ", " BELOW ", 1).replace("IDENTIFIER", "ID", 1)) for n in ("mit", "isc", "bsd-3-clause", "apache-2.0", "zlib")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for n in names:
        assert n in got[n]["labels"].split(","), n
        assert 0 < got[n]["score"] <= 1
    for n, _ in rows[len(names) :]:
        assert n.split()[0] not in got[n]["labels"].split(","), n


def test_license_query_against_patterns_on_whole_tables(spark, odd):
    data = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: r for r in queries.op13_licenses(spark, SF).collect()}
    assert len(got) == len(data)
    notices = [x for x in licenses.TEMPLATES if len(re.sub(r"\[\[.*\]\]", "", x[1], flags=re.DOTALL)) < 150]
    starts = re.compile(r"licen|spdx|permission|redistribution|free software|unencumbered")
    for d, t in data:
        words = PLAIN.findall(lower(t))
        near = sorted({i for i, w in enumerate(words) if starts.search(w)})
        places = brute_places(t, [], licenses.PHRASES)
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(p[2] for p in places), max(p[2] for p in places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        inside = sorted({w for i in near for w in range(max(0, i - 12), min(len(words), i + 30))})
        stretches = np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1) if inside else []
        # notices are short; whole licenses are tested above
        want = {p[1] for x in stretches for p in brute_places(" ".join(words[i] for i in x), notices, licenses.PHRASES)}
        assert set(r["labels"].split(",")) - {""} == want
    for r in licenses.scan_licenses(odd).collect():
        assert r["score"] == 0 or r["labels"]
    assert sorted(r["n_base"] for r in licenses.scan_licenses(odd).collect() if r["n_words"] > 10000)[0] > 10
    assert licenses.scan_licenses(odd.where("false")).count() == 0


def test_words_in_places_count_once():
    assert licenses.covered(np.array([0, 2, 2, 10]), np.array([4, 3, 6, 11])) == 7
    s = licenses.scan(licenses.compile_templates(), pa.array([None, "under the MIT License", ""]))
    assert s.n_words.tolist() == [0, 4, 0] and set(s.label) == {"mit"}
