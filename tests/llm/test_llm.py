"""Dealt operators against brute force, exact round trips, held-out accuracy, and the odd cases: nulls in any column,
empty and long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import bpe, components, decontaminate, exact, ngrams, pii, quality, queries, shards, simhash, substring, textops, toxicity
from loomspan.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, repeats, and extra columns named like internal ones."""
    rng = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma", "x1", "été", "日本", "d-e", "it's", "12", "kg", "The", "end."]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = text(9000)
    body = [None, "", "  \n\t ", "one", "one two three", text(60), text(60), long, long + " tail", long, "same text here", "same text here", text(40) + "\n" + long[:700] + " é", "a" * 5000]
    data = [(i, t, None if i % 3 else "en", "k", i % 2) for i, t in enumerate(body)] + [(None, "no id", "en", None, None), (5, body[5], "en", "k", 1), (5, "other text", None, "k", 1), (None, None, None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, k1 string, bucket int").cache()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# text handling


def test_words_hashes_and_joins():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\téx") for _ in range(rng.randrange(60))) for _ in range(800)] + [None, ""]
    for begin, end, buf, offsets in textops.slices(pa.array(texts), 500):
        w = textops.find_words(buf, offsets)
        expected = [words(t) for t in texts[begin:end]]
        assert [[buf[w.starts[j] : w.ends[j]].tobytes().decode() for j in range(w.first[i], w.first[i + 1])] for i in range(end - begin)] == expected
        seen = {}
        for x, h in zip(sum(expected, []), textops.word_hashes(w), strict=True):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)
        flat, bounds = textops.joined(w)
        assert [textops.text_of(flat, bounds, i).decode() for i in range(end - begin)] == [" ".join(x) for x in expected]


def test_hashes_do_not_depend_on_position_or_block():
    t = ("pad " * 70_000 + "needle in hay ").encode()
    twice = np.frombuffer(t + t, np.uint8)
    w = textops.find_words(twice, np.array([0, len(twice)]))
    h = textops.word_hashes(w)
    n = len(h) // 2
    assert (h[:n] == h[n:]).all() and len(set(h.tolist())) == 4
    g = textops.window_hashes(h, 3)
    assert (g[: n - 2] == g[n : 2 * n - 2]).all()


# 1 substring dedup


def brute_substrings(rows, k):
    seen = Counter(tuple(w[i : i + k]) for w in (words(t) for _, t in rows) for i in range(len(w) - k + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if seen[tuple(w[s : s + k])] > 1:
                gone[s : s + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [22, 35])
def test_substring_dedup(spark, odd, length):
    for df in (odd, table(spark, SF, "documents")):
        got = sorted((tuple(r) for r in substring.remove_repeats(df, length, digest=True).collect()), key=repr)
        assert got == brute_substrings(pairs(df), length)


def test_substring_texts_and_empty(odd, nothing):
    r = {x["doc_id"]: x for x in substring.remove_repeats(odd, 35).collect()}
    assert r[3]["kept"] == "one" and r[0]["kept"] == ""
    assert substring.remove_repeats(nothing, 35).count() == 0
    many, few = ({(x["doc_id"], x["n_removed"], x["kept"]) for x in substring.remove_repeats(odd, 35, bucket_bytes=n).collect()} for n in (1000, 1 << 30))
    assert many == few
    with pytest.raises(ValueError):
        substring.remove_repeats(odd, 21)


def test_cover_holds_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


# 2 personal data


def brute_base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("a@@.-+1234 9()é\n_%") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_base(t)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("1" * 200_000 + ".2.3.4") == []
    for place in range(4):  # more digits than Python reads as a number
        for last, ok in (("7", True), ("255", True), ("256", False), ("", True)):
            parts = ["1", "2", "3", "4"]
            parts[place] = "0" * 5000 + last
            ip = ".".join(parts)
            assert pii.base_spans(f"x {ip} y") == [(1, 2, 2 + len(ip))] * ok


def test_pii_of_long_zeros_in_query_and_redaction(spark):
    parts = [["0" * 5000 + p if i == j else p for j, p in enumerate("1234")] for i in range(4)]
    texts = ["x " + ".".join(p) + " y" for p in parts] + ["x 1.2.3." + "0" * 5000 + "256"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest_pii(df).collect()}
    assert [got[i]["n_ip"] for i in range(5)] == [1, 1, 1, 1, 0]
    assert [got[i]["base_sha256"] for i in range(4)] == [hashlib.sha256(f"ip:2:{len(t) - 2}".encode()).hexdigest() for t in texts[:4]]
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.fit_field(df)).collect()}
    assert [hidden[i] for i in range(4)] == ["x <ip> y"] * 4


def test_pii_query_and_added_spans(spark, odd, nothing):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in pii.digest_pii(df).collect()}
    for i, t in pairs(df):
        base = brute_base(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == j for k, _, _ in base) for j in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(got[i]["spans"].split(","))
    field = pii.fit_field(df)
    swallowed = "call +1 (269) 555-3296 4524132264652813 now"
    assert pii.base_spans(swallowed) == [] or all(k != 3 for k, _, _ in pii.base_spans(swallowed))
    assert any(k == 3 for k, _, _ in pii.added_spans(swallowed, pii.base_spans(swallowed), field, 0.9))
    assert pii.added_spans("only plain words here", [], field, 0.9) == []
    assert pii.digest_pii(odd).count() == odd.count() and pii.digest_pii(nothing).count() == 0
    hidden = pii.redact(spark.createDataFrame([(1, "mail a.b@c.org or 1.2.3.4"), (2, None)], "doc_id long, text string"), field)
    assert [r["text"] for r in hidden.orderBy("doc_id").collect()] == ["mail <email> or <ip>", None]


def test_skip_edges_make_labels_agree():
    field = pii.Field()
    field.ready = True
    field.skip = np.where(np.eye(5, dtype=bool), 3.0, -3.0)
    tokens = pii.Tokens("x12345y then words x12345y")
    observed = np.array([1, 0])
    assert tokens.skip.tolist() == [[0, 1]] and field.marginals(tokens, observed)[1].argmax() == 1


def test_marginals_are_exact_on_a_tree():
    rng = np.random.default_rng(4)
    field = pii.Field()
    field.ready = True
    field.node, field.chain, field.skip = rng.normal(size=field.node.shape), rng.normal(size=(5, 5)), rng.normal(size=(5, 5))
    field.skip = (field.skip + field.skip.T) / 2
    tokens = pii.Tokens("12 34 word 56 word 12")
    assert tokens.chain.tolist() == [[0, 1]] and tokens.skip.tolist() == [[0, 3]]
    for observed in ([0, 0, 0, 0], [0, 2, 0, 0]):
        unary = field.node[tokens.features].sum(1)
        want = np.zeros((4, 5))
        for y in np.ndindex(5, 5, 5, 5):
            if all(o in (0, k) for o, k in zip(observed, y, strict=True)):
                want[range(4), y] += np.exp(unary[range(4), y].sum() + field.chain[y[0], y[1]] + field.skip[y[0], y[3]])
        want /= want.sum(1, keepdims=True)
        assert np.allclose(field.marginals(tokens, np.array(observed), rounds=80), want, atol=1e-6)


def test_hidden_spans_come_back_and_long_texts_are_linear(spark):
    texts = [t for _, t in sorted(pairs(table(spark, "/root/testdata/sf0.1", "documents"))) if t and re.search("[0-9@]", t)][:3000]
    field = pii.fit_texts(texts[::2])
    found = pii.recovered(texts[1::2], field)
    hidden, back, other = (sum(v[i] for v in found.values()) for i in range(3))
    assert hidden > 50 and back / hidden > 0.8 and other < 0.2 * back, found
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**9)) for _ in range(100_000))
    began = time.process_time()
    base = pii.base_spans(text)
    pii.added_spans(text, base, field, 0.95)
    assert time.process_time() - began < 6


# 3 toxicity


def test_gradients():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n, at = np.array([70, 5, 1]), np.array([21, 0, 0])
    rows = rng.integers(1, 50, (n.sum() + 1, toxicity._FEATURES + 1))
    rows[-1] = 0
    some = toxicity._gather(rows, np.array([0, 70, 75]), n, np.arange(3), at)
    begin = np.concatenate([[0, 0], np.cumsum(rng.integers(1, 12, 49))])
    letters = toxicity.Letters(rng.integers(97, 123, begin[-1]).astype(np.uint8), begin)
    y = np.array([1.0, 0, 1])
    g = net.gradients(some, y, letters)

    def loss():
        z = net.forward(some, letters)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    for k in net.p:
        index = np.unravel_index(np.abs(g[k]).argmax(), net.p[k].shape) if k != "table" else None
        at, value = ((int(g[k][0][5]), 2), g[k][1][5, 2]) if k == "table" else (index, g[k][index])
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up = loss()
        net.p[k][at] = old - 1e-4
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-4 - value) < 1e-4


def test_windows_cover_every_word():
    n = np.array([0, 1, 32, 33, 48, 49, 200])
    text, at = toxicity.windows(n)
    for i, k in enumerate(n):
        starts = at[text == i]
        assert len(starts) >= 1 and (np.diff(starts) == toxicity.STRIDE).all()
        assert k <= starts[-1] + toxicity.SPAN and (k == 0 or starts[-1] < k)


def test_every_window_is_scored():
    """Against a plain recurrence, one word and one window at a time."""
    net, rng = toxicity.Network(3), random.Random(9)
    texts = [" ".join(rng.choice(["bad", "good", "Fool!", "x", "...", "éa", "w" * 40]) for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 64, 65, 150)]
    buf, offsets = textops.buffers(pa.array(texts))
    found = textops.find_words(buf, offsets)
    rows, letters = toxicity.word_features(found)
    p, H, S, B = net.p, toxicity.HIDDEN, toxicity.SPAN, toxicity.BLOCK
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def spelled(i):
        b = [0, *letters.flat[letters.begin[i] : letters.begin[i + 1]].tolist(), 0]
        return np.tanh(np.max([p["T"][0][b[j - 1]] + p["T"][1][b[j]] + p["T"][2][b[j + 1]] for j in range(1, len(b) - 1)], 0)) @ p["P"]

    want = []
    for i in range(len(texts)):
        x = [sum(p["table"][f] for f in r[:-1]) + spelled(r[-1]) for r in rows[found.first[i] : found.first[i + 1]]]
        n = len(x)
        states = np.zeros((n, 2 * H))
        for d in (0, 1):
            seq = x if d == 0 else x[::-1]
            for t in range(n):
                h = np.zeros(H)
                for u in range(max(0, t // B * B - B), t + 1):
                    g, gu = seq[u] @ p["W"][d] + p["b"][d], h @ p["U"][d]
                    z, r = sigmoid(g[:H] + gu[:H]), sigmoid(g[H : 2 * H] + gu[H : 2 * H])
                    h = z * h + (1 - z) * np.tanh(g[2 * H :] + r * gu[2 * H :])
                states[t if d == 0 else n - 1 - t, d * H : (d + 1) * H] = h
        logits = []
        for a in range(max(1, n - S + 1)):
            part = states[a : a + S]
            w = np.exp(np.tanh(part @ p["A"]) @ p["v"])
            logits.append((w / w.sum()) @ part @ p["o"] + p["c"][0] if len(part) else p["c"][0])
        want.append(sigmoid(max(logits)))
    assert np.allclose(toxicity.text_scores(net, found), want, atol=1e-5)


def test_the_trained_network_is_the_served_one():
    """The training pass gives every window of every text the logit that scoring gives it."""
    net, rng = toxicity.Network(4), random.Random(8)
    net.p = {k: v * (40 if k in ("table", "P") else 1) for k, v in net.p.items()}
    texts = [" ".join(rng.choice(["bad", "good", "Fool!", "x", "...", "éa", "w" * 40, str(i)]) for i in range(n)) for n in (0, 1, 3, 4, 5, 31, 32, 33, 64, 65, 97, 150)]
    buf, offsets = textops.buffers(pa.array(texts))
    found = textops.find_words(buf, offsets)
    rows, letters = toxicity.word_features(found)
    n = np.diff(found.first)
    text, at = toxicity.windows(n, stride=1)
    trained = net.forward(toxicity._gather(np.concatenate([rows, np.zeros_like(rows[:1])]), found.first, n, text, at), letters)
    begin = found.first[text] + at
    served = toxicity.window_logits(net, *toxicity.readings(net, rows, net.spelled(letters), found.first, most=40), begin, np.minimum(begin + toxicity.SPAN, found.first[text + 1]))
    assert np.ptp(served) > 0.1 and np.allclose(trained, served, atol=1e-4)
    highest = [trained[text == i].max() for i in range(len(texts))]
    assert np.allclose(toxicity.text_scores(net, found), 1 / (1 + np.exp(-np.array(highest))), atol=1e-5)


def held_out_accuracy(scored, labels, column):
    rows = scored.where("held_out").join(labels.groupBy("doc_id").agg(F.max(column).alias("y")), "doc_id").select("score", "predicted", "y").collect()
    return np.array([r["score"] for r in rows]), np.array([r["predicted"] for r in rows]), np.array([r["y"] for r in rows])


def test_toxicity_held_out(spark, odd, nothing):
    sf = "/root/testdata/sf0.1"
    score, predicted, y = held_out_accuracy(toxicity.classify_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")), table(spark, sf, "labels"), "toxic")
    assert (predicted == y).mean() > 0.95 and predicted[y == 1].mean() > 0.8 and ((score >= 0) & (score <= 1)).all()
    assert ((score >= 0.7) == (predicted == 1)).all()
    net = toxicity.fit([("bad idiot", 1), ("good day", 0)] * 20)
    assert toxicity.score_toxicity(odd, net).count() == odd.count() and toxicity.score_toxicity(nothing, net).count() == 0
    assert toxicity.drop_toxic(odd, net).columns == odd.columns
    for sample, prior in (([], 0.0), ([("x", 0)], 0.0), ([("x", 1)], 1.0), ([(" ", 1), ("x", 0)], 0.5)):
        assert toxicity.batch_scores(toxicity.fit(sample), pa.array(["a", None])).tolist() == [prior] * 2


# 4 language model


def test_elias_fano_and_quantisation():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        for spread in (40, 63):
            v = np.sort(rng.integers(0, 1 << 62, n, dtype=np.int64).astype(np.uint64) >> rng.integers(0, spread, n).astype(np.uint64))
            level = ngrams.EliasFano.of(v)
            assert (level.at(np.arange(n)) == v).all()
            x = np.concatenate([v, v + np.uint64(1), rng.integers(0, 1 << 62, 500, dtype=np.int64).astype(np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
            assert (level.successor(x) == np.searchsorted(v, x)).all()
            there = level.find(x)[1]
            assert (there == np.isin(x, v)).all()
    v = np.unique((rng.integers(0, 300, 4000).astype(np.uint64) << np.uint64(24)) | rng.integers(0, 1 << 24, 4000).astype(np.uint64))
    level, high = ngrams.EliasFano.of(v, 3), v >> np.uint64(24)
    x = np.concatenate([v[::3], v[::5] ^ np.uint64(1)])
    lo, hi = (np.searchsorted(high, x >> np.uint64(24), side) for side in ("left", "right"))
    i, there = level.find_within(x & np.uint64((1 << 24) - 1), lo, hi)
    assert (there == np.isin(x, v)).all() and (v[i[there]] == x[there]).all()
    p = np.array([0, 1, 0.5, 1e-9, 1 / 21])
    q = ngrams.dequantise(ngrams.quantise(p))
    assert q[0] == 0 and q[1] == 1 and (abs(q[1:] / p[1:] - 1) < 0.07).all()
    k = np.sort(rng.integers(0, 1 << 62, 999, dtype=np.int64).astype(np.uint64))
    assert (ngrams._unpack(ngrams._pack(k)) == k).all()


def test_trie_finds_by_context_and_counts_beyond_32_bits():
    rng = np.random.default_rng(2)
    some = lambda n: np.unique((rng.integers(0, n, 5000).astype(np.uint64) << ngrams._SUCCESSOR) | rng.integers(0, 1 << 20, 5000).astype(np.uint64))
    keys = some(200)
    counts = rng.integers(1, 1 << 40, len(keys))
    counts[7] = (1 << 32) + 7
    totals = counts * 3
    trie = ngrams.Trie(keys, counts, totals, 20.0)
    codes, found = trie.look_up(keys)
    assert (found == counts).all() and (codes == ngrams.quantise(counts / (totals + 20.0))).all()
    other = np.setdiff1d(some(300), keys)
    word = rng.integers(0, 1 << 62, 999, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
    nth = rng.integers(0, np.bitwise_count(word))
    assert ngrams._nth_bit(word, nth).tolist() == [[b for b in range(64) if int(w) >> b & 1][n] for w, n in zip(word, nth, strict=True)]
    assert (ngrams._sums(np.array([0, 1, 0]), np.array([(1 << 60) + 3, 5, 1 << 60]), 2) == [(1 << 61) + 3, 5]).all()
    assert not trie.look_up(other)[1].any() and not ngrams.Trie(keys[:0], counts[:0], totals[:0], 1.0).look_up(keys)[0].any()


def brute_lm(rows, order=3, prior=20.0):
    docs = [(i, [*words(lower(t)), "</s>"]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = {k: Counter() for k in range(order + 1)}
    grams = lambda w, k: zip(*([*["<s>"] * (k - 1), *w][j:] for j in range(k)), strict=False)
    for i, w in docs:
        if not held(i):
            for k in range(1, order + 1):
                c[k].update(grams(w, k))
    n, v = sum(c[1].values()), len(c[1])
    history = {k: Counter() for k in range(1, order)}
    for k in range(2, order + 1):
        for g, m in c[k].items():
            history[k - 1][g[:-1]] += m
    q = lambda p: float(ngrams.dequantise(ngrams.quantise(np.array([p])))[0])
    out = []
    for i, w in docs:
        base = model = 0.0
        for g in grams(w, order):
            p = (c[1][g[-1:]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                h = history[k - 1][g[-k:-1]]
                p = q(c[k][g[-k:]] / (h + prior)) + prior / (h + prior) * p
            model += math.log10(min(p, 1))
        out.append((i, held(i), len(w), sum(c[1][x,] > 0 for x in w), n, base, model, model / len(w)))
    return out


@pytest.mark.parametrize("chunk", [100_000, 12 << 20])
@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, odd, nothing, chunk, order):
    for df in (table(spark, SF, "documents"), odd):
        key = lambda r: (repr(r[0]), r[2], r[5])
        got, want = (sorted(x, key=key) for x in ([tuple(r) for r in ngrams.score_texts(df, chunk_bytes=chunk, order=order, shard_bytes=130_000).collect()], brute_lm(pairs(df), order)))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(abs(g[k] - w[k]) <= 1e-9 * abs(w[k]) + 1e-9 for g, w in zip(got, want, strict=True) for k in (5, 6, 7))
    assert ngrams.score_texts(nothing).count() == 0


# 5 exact dedup


def test_repeated_rows_are_dealt_over_all_chunks(spark):
    same = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a text that repeats").alias("text"))
    sizes = [r["count"] for r in ngrams.dealt(same, 10, 0, 50).groupBy("chunk").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 2 * 100_000 / 50
    got = ngrams.score_texts(same.limit(5000), chunk_bytes=4000).groupBy("n_tokens", "n_known", "train_tokens", "base_score", "score").count().collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["count"]) for r in got] == [(5, 5, 25_000, 5000)]


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    named = spark.createDataFrame([("a", "t")], "doc_id string, text string")
    for f in (lambda: exact.exact_groups(named), lambda: shards.assign_shards(named, 4)):
        with pytest.raises(TypeError):
            f()


def test_patricia_trie_and_spill():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(2000)] + [b"x" * 5000, b"x" * 4999 + b"y", b"x" * 5000]
    trie, want = exact.PatriciaTrie(), defaultdict(list)
    for i, t in enumerate(texts):
        trie.insert(t, i, i)
        want[t].append(i)
    assert {t: (n.first, n.last, n.rows) for t, n in trie.terminals()} == {t: (min(v), max(v), len(v)) for t, v in want.items()}
    assert trie.held == sum(trie.weight.values()) > 0
    spilled, weights = {}, []
    while part := trie.spill():
        weights.append(sum(len(t) for t, _ in part))
        spilled |= {t: n.rows for t, n in part}
    assert spilled == {t: len(v) for t, v in want.items()} and len(weights) == 3 and trie.held == 0


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    top = {t: max((i for i in v if i is not None), default=None) for t, v in groups.items()}
    out, taken = [], set()
    for i, t in rows:
        kept = i == top[t or ""] and t not in taken if t is not None else i == top[""] and "" not in taken
        if kept:
            taken.add(t or "")
        out.append((i, top[t or ""], len(groups[t or ""]), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [48 << 20, 3000])
def test_exact_dedup(spark, odd, nothing, budget):
    for df in (odd, table(spark, SF, "documents")):
        rows = pairs(df)
        assert sorted((tuple(r) for r in exact.exact_groups(df).collect()), key=repr) == brute_exact(rows)
        want = Counter(t or "" for _, t in rows)
        got = [(bytes(r["digest"]), r["rows"]) for r in exact.owners(df, budget=budget).collect()]
        assert sorted(got) == sorted((hashlib.sha256(t.encode()).digest(), n) for t, n in want.items())
    small = {r["text_sha256"]: r["keep_id"] for r in exact.exact_groups(odd, keep="smallest").collect()}
    assert small[hashlib.sha256(b"same text here").hexdigest()] == 10
    assert exact.exact_groups(nothing).count() == 0


def test_exact_dedup_keeps_one_of_rows_that_repeat_id_and_text(spark):
    data = [(3, "a")] * 5 + [(None, "b")] * 3 + [(1, "a"), (2, "c"), (2, "c"), (2, "d")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for piece in (1 << 16, 2):
        assert sorted((tuple(r) for r in exact.exact_groups(df, piece=piece).collect()), key=repr) == brute_exact(data)


# 6 SimHash


def brute_fingerprint(t):
    w = words(lower(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(fps, within=4):
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= within
    lab = np.arange(len(a))
    while True:
        new = np.where(near, lab[None, :], len(a)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_simhash(spark, odd, nothing):
    for df in (table(spark, SF, "documents"), odd):
        rows = sorted(pairs(df), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        fps = [brute_fingerprint(t) for _, t in rows]
        lab = brute_labels(fps)
        want = sorted(((i, f"{f:016x}", min((rows[j][0] for j in range(len(rows)) if lab[j] == k and rows[j][0] is not None), default=None)) for (i, _), f, k in zip(rows, fps, lab, strict=True)), key=repr)
        assert sorted((tuple(r) for r in simhash.near_groups(df).collect()), key=repr) == want
    assert simhash.near_groups(nothing).count() == 0


def test_links_of_dense_groups(spark):
    rng = np.random.default_rng(0)
    fps = set()
    for x in rng.integers(0, 1 << 63, 12, dtype=np.int64):
        for _ in range(60):
            y = int(x)
            for b in rng.integers(0, 64, rng.integers(0, 9)):
                y ^= 1 << int(b)
            fps.add(simhash._signed(y & simhash._ALL))
    fps = sorted(fps)
    lab = brute_labels(np.array(fps, np.int64).view(np.uint64))
    for crowd in (4096, 8):  # with 8, most values are dealt again
        got = {r["node"]: r["label"] for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, crowd)).collect()}
        assert [got.get(f, f) for f in fps] == [fps[k] for k in lab]


def test_chains_find_every_link_and_nothing_else():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64)
    diff = np.zeros(len(base), np.uint64)
    for i in range(len(diff)):
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            diff[i] ^= np.uint64(1) << np.uint64(b)
    for within in (0, 1, 2, 3, 4):
        found = np.zeros(len(base), bool)
        for start, mask, change in simhash.probes(within):
            s = np.full(len(base), start)
            filed, asked = (simhash.turned(x, s) & np.uint64(mask) for x in (base, base ^ diff))
            found |= (filed == (asked ^ np.uint64(change))) & simhash.ring(simhash.turned(diff, s), s, within)
        assert (found == (np.bitwise_count(diff) <= within)).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (-5, -4)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, -5: -5, -4: -5}


# 7 sharding


def jump_once(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, odd, nothing):
    keys = np.array([0, 1, -1, 5, 10**12, *range(500)])
    for n in (1, 2, 40, 41):
        assert shards.jump(keys, n).tolist() == [jump_once(int(k), n) for k in keys]
    for df in (odd, table(spark, SF, "documents")):
        rows = shards.assign_shards(df, 40).collect()
        slots = defaultdict(list)
        for r in rows:
            assert r["shard"] == jump_once(r["doc_id"] or 0, 40) and r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        size = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(((i, *size(t)) for i, t in pairs(df)), key=repr)
    assert shards.assign_shards(nothing, 40).count() == 0


# 8 quality


def test_quality_held_out(spark, odd, nothing):
    sf = "/root/testdata/sf0.1"
    score, predicted, y = held_out_accuracy(quality.classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels")), table(spark, sf, "labels"), "quality")
    assert (predicted == y).mean() > 0.95 and (1 - predicted[y == 0]).mean() > 0.75
    assert ((score >= 0.3) == (predicted == 1)).all() and ((score >= 0) & (score <= 1)).all()
    model = quality.fit([("plain words in a row " * 5, 1), ("###$$$ !!!", 0)] * 40)
    assert quality.score_quality(odd, model).count() == odd.count() and quality.score_quality(nothing, model).count() == 0
    assert quality.fit([]).probability.tolist() == [0.5] and quality.fit([("a", 1)]).probability.tolist() == [1.0]


def test_isotonic():
    x, p = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [1.0, 2.5, 4.0] and (np.diff(p) > 0).all()


def test_quality_scores_recomputed(spark):
    """Gains block by block, and the isotonic map by its minimax formula."""
    import zstandard

    rng = random.Random(3)
    sample = [(" ".join(rng.choice(["river", "stone", "of", "the"] if y else ["###", "$$", "buy", "now!!"]) for _ in range(rng.randrange(5, 300))), y) for y in (0, 1) * 60]
    model = quality.fit(sample, share=0.25)
    texts = [None, "", "of the river " * 200, "buy now!! " * 7, "é" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score_quality(df, model).collect():
        t = (texts[r["doc_id"]] or "").encode()
        size = lambda d, x: len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
        gain = sum(size(model.bad, t[i : i + model.block]) - size(model.good, t[i : i + model.block]) for i in range(0, max(len(t), 1), model.block)) / (len(t) + 20)
        assert abs(r["raw_gain"] - gain) < 1e-12 and abs(r["score"] - np.interp(gain, model.raw, model.probability)) < 1e-12
    x, y, w = np.sort(np.random.default_rng(1).normal(size=40)), np.random.default_rng(2).integers(0, 2, 40).astype(float), np.random.default_rng(3).uniform(0.5, 2, 40)
    mean = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()
    fitted = [max(min(mean(a, b) for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    pools = [list(g) for _, g in itertools.groupby(range(40), key=lambda i: round(fitted[i], 12))]
    got_x, got_p = quality.isotonic(x, y, w)
    assert np.allclose(got_x, [(x[g] * w[g]).sum() / w[g].sum() for g in pools]) and np.allclose(got_p, [((y[g] * w[g]).sum() + 0.5) / (w[g].sum() + 1) for g in pools])


# 9 decontamination


def test_templates():
    find = lambda item, doc: list(decontaminate.find(decontaminate.prepare([(1, item)], 5), pa.array([doc]), 5, 0.8))
    q = "If Alice has 12 apples and Bob gives Alice 7 kg more of them, how many apples does Alice have after that day?"
    same, other = ("Text here. If Carol has 15 apples and Dave gives {} 9 kg more of them, how many apples does Carol have after that day? more".format(x) for x in ("Carol", "Erin"))
    assert find(q, same) == [(0, 0, 19, 19, True)] and find(q, other) == [] and find(q, q)[0][4] is False
    assert find("1 2 3 4 5 6", "7 8 9 1 2 3") == [] and find("too short", "too short") == [] and find(q, None) == []


def test_decontamination(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    plain = lambda t: f" {' '.join(words(t))} "
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    verbatim = {(i, k) for i, t in pairs(docs) for k, x in items if x in plain(t)}
    assert verbatim and verbatim <= got and len(got - verbatim) <= 3
    assert got == {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, block=2000).collect()}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({i for i, _ in got})
    strange = spark.createDataFrame([(None, "alpha Beta gamma x1 été 日本"), (1, None), (2, "")], "item_id long, text string")
    assert decontaminate.contaminated(odd, strange).columns and decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.where("false")).count() == 0


def plain_tokens(text):
    """(kind, value) of every token, read character by character."""
    out, last = [], None
    for m in WORD.finditer(text or ""):
        core = [i for i, c in enumerate(m[0]) if c.isascii() and c.isalnum() or ord(c) > 127]
        if not core:
            continue
        word = m[0][core[0] : core[-1] + 1]
        digit, letter = [bool(re.search(x, word)) for x in ("[0-9]", "[A-Za-z\x80-\U0010ffff]")]
        value, kind = lower(word), decontaminate.WORD
        measured = re.fullmatch(r"([0-9][^A-Za-z\x80-\U0010ffff]*)([A-Za-z\x80-\U0010ffff][^0-9]*)", word)
        if digit and not letter:
            kind = decontaminate.NUMBER
        elif measured and lower(measured[2]) in decontaminate.UNITS:
            kind = decontaminate.QUANTITY
        elif value in decontaminate.UNITS and out and out[-1][0] == decontaminate.NUMBER:
            kind = decontaminate.UNIT
        begin = m.start() + core[0]
        if "A" <= word[0] <= "Z" and not digit and last is not None and not re.search("[.!?:\n\r]", text[last:begin]):
            kind = decontaminate.NAME
        last = m.start() + core[-1] + 1
        out.append((kind, value))
    return out


def plain_most(pairs_):
    seen = {}
    for k, v, same in pairs_:
        n, _ = seen.setdefault(k, {}).get(v, (0, same))
        seen[k][v] = (n + 1, same)
    return {k: max(per, key=per.get) for k, per in seen.items()}


def plain_holds(item, doc, size=5, share=0.8):
    """Whether a document holds an item, every window against every window."""
    a, b = plain_tokens(item), plain_tokens(doc)
    if not a:
        return False
    if len(a) < size:
        return any([v for _, v in b[j : j + len(a)]] == [v for _, v in a] for j in range(len(b) - len(a) + 1))
    word = decontaminate.WORD
    template = lambda t: [v if k == word else k for k, v in t]
    good, diagonals = set(), defaultdict(list)
    for i in range(len(a) - size + 1):
        for j in range(len(b) - size + 1):
            x, y = a[i : i + size], b[j : j + size]
            if [v for _, v in x] == [v for _, v in y]:
                good.add(i)
            if template(x) == template(y) and any(k == word for k, _ in x):
                diagonals[j - i].append(i)
    for d, at in diagonals.items():
        slots = sorted({p for i in at for p in range(i, i + size) if a[p][0] != word})
        asked, given = [a[p] for p in slots], [(a[p][0], b[p + d][1]) for p in slots]
        same = [x == y for x, y in zip(asked, given, strict=True)]
        there, back = plain_most(zip(asked, given, same, strict=True)), plain_most(zip(given, asked, same, strict=True))
        agrees = {p: there[x] == y and back[y] == x for p, x, y in zip(slots, asked, given, strict=True)}
        verbatim = dict(zip(slots, same, strict=True))
        good |= {i for i in at if any(all(f[p] for p in slots if i <= p < i + size) for f in (verbatim, agrees))}
    windows = range(len(a) - size + 1)
    literal = [i for i in windows if any(k == word for k, _ in a[i : i + size])]
    found = [(len(good & set(literal)), len(literal)), (len(good), len(windows))]
    return any(n and n >= share * of for n, of in found)


def test_templates_against_every_window(spark):
    """Questions with other numbers, names, units and words, and whole ones, in a table of documents."""
    rng = random.Random(11)
    names, units = ["Alice", "Bob", "Carol", "Dana"], ["kg", "km", "hours", "dollars"]
    question = lambda: " ".join(rng.choice([rng.choice(names), str(rng.randrange(20)), rng.choice(units), f"{rng.randrange(9)}kg", "has", "gives", "how", "many", "apples", "left.", "the", "to", "Then"]) for _ in range(rng.randrange(2, 25)))
    items = [question() for _ in range(25)] + ["12 34 56 78 90", "7 kg", "?!", ""]

    def changed(text):
        swap = {**dict(zip(names, rng.sample(names, 4), strict=True)), **{str(i): str(rng.randrange(20)) for i in range(20)}}
        return " ".join(rng.choice(names) if rng.random() < 0.02 else swap.get(w, w) for w in text.split())

    docs = [f"{question()} {rng.choice([changed, str])(rng.choice(items))} {question()}" for _ in range(150)] + [None, "", "has"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    want = {(i, k) for i, t in enumerate(docs) for k, x in enumerate(items) if plain_holds(x, t)}
    assert got == want and len(want) > 60
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()) == sorted(set(range(len(docs))) - {i for i, _ in want})


def test_many_items_of_one_template_meet_in_turns():
    items = [(i, f"how many apples does Alice have when Bob gives her {i} more of them and {i + 1} pears") for i in range(60)]
    column = pa.array([f"So how many apples does Carol have when Dave gives her {i} more of them and {i + 1} pears" for i in range(0, 60, 7)])
    prepared = decontaminate.prepare(items, 5)
    buf, offsets = textops.buffers(column)
    t = decontaminate.tokens(buf, offsets)
    whole, parts = (sorted(decontaminate._by_windows(prepared, t, 5, 0.8, most)) for most in (1 << 22, 100))
    assert whole == parts and {(d, i) for d, i, *_ in whole} >= {(k, i) for k, i in enumerate(range(0, 60, 7))}


def test_one_changed_slot_and_short_or_numeric_items(spark):
    find = lambda item, doc: [x[2:] for x in decontaminate.find_all(decontaminate.prepare([(1, item)], 5), pa.array([doc]), 5, 0.8)]
    item = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59)]
    item[10] = item[40] = "7"
    item[25] = "8"
    for at, value in ((40, "9"), (25, "7")):
        doc = [*item[:at], value, *item[at + 1 :]]
        assert find(" ".join(item), "so " + " ".join(doc) + " so") == [(50, 55, False)]
    both = [{"7": "9", "8": "7"}.get(w, w) for w in item]
    assert find(" ".join(item), " ".join(both)) == [(55, 55, True)]
    digits = "1 2 3 4 5 6 7 8 9 10"
    assert find(digits, f"count {digits} up") == [(6, 6, False)] and find(digits, "count 2 1 4 3 6 5 8 7 10 9 up") == []
    assert find("Sum: " + digits, f"the sum: {digits}") == [(1, 1, False)]
    assert find("Paris is the capital of", "that Paris is the capital of it") == [(1, 1, False)]
    assert find("Who is Ada?", "one asked: who is Ada") == [(1, 1, False)] and find("Who is Ada?", "who is Bob, Ada is who") == [] and find("?!", "?!") == []
    bench = spark.createDataFrame([(1, "Who is Ada?"), (2, digits), (3, "?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {digits}"), (2, "asks who is Ada"), (3, "1 2 3 ? who is"), (4, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 2), (2, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [3, 4]


# 10 BPE


def test_bpe_matches_the_library(spark, odd, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(2)
    texts = ["", "a<|endoftext|>b <|endoftext|><|endoftext|>", "x" * 3000, " \t\n  hello　 world\x1c\x1d y\x85z  ", "I'll don't 'S é́ ²½ ١٢ 日本語 \U0001f600‍"]
    texts += [chr(a) + "a " + chr(a) + " 1" for a in range(0, 0x110000, 97) if not 0xD800 <= a < 0xE000]
    texts += ["".join(rng.choice("ab 'st<|endof>\n\t12é") for _ in range(rng.randrange(1, 40))) for _ in range(1000)]
    texts += ["".join(rng.choice(a) for _ in range(n)) for n in (600, 4000) for a in ("ab", "the cat", "aaab", "etaoinshrdlu")] + ["a" * 5001, "ab" * 3000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))]
    assert bpe.Vocabulary(path).in_order
    for remember in (400_000, 50):
        coder = bpe.Coder(path, remember)
        for at in range(0, len(texts), 400):
            part = texts[at : at + 400]
            for got, want, t in zip(coder.encode(part), library.encode_batch(part, add_special_tokens=False), part, strict=True):
                ids = np.frombuffer(got, "<u4")
                assert ids.tolist() == want.ids and coder.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == t
    digest = sorted((tuple(r) for r in bpe.digests(odd, path).collect()), key=repr)
    want = sorted(((i, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(odd) for e in [library.encode(t or "", add_special_tokens=False)]), key=repr)
    assert digest == want and bpe.digests(nothing, path).count() == 0
    back = bpe.decode(bpe.encode(odd, path), path)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in pairs(odd)), key=repr)


# pipeline


def test_pipeline(spark):
    sf = SF
    docs, at = table(spark, sf, "documents"), {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "BPE"]
    before = docs
    for n, stage in corpus_pipeline.STAGES:
        at[n] = before = stage(spark, before, sf).cache()
    rows = {n: pairs(at[n]) for n in names[:-1]}
    net = toxicity.fit_toxicity(docs, table(spark, sf, "labels"))
    scores = {}
    for i, t in pairs(docs):
        buf, offsets = textops.buffers(pa.array([t or ""]))
        scores[i, t] = toxicity.text_scores(net, textops.find_words(buf, offsets))[0]
    assert sorted(rows["toxicity"]) == sorted(k for k, v in scores.items() if v < 0.7) and len(rows["toxicity"]) < len(scores)
    texts = defaultdict(list)
    for i, t in rows["toxicity"]:
        texts[t].append(i)
    assert sorted(rows["exact dedup"]) == sorted((max(v), t) for t, v in texts.items())
    kept = sorted(rows["exact dedup"])
    lab = brute_labels([brute_fingerprint(t) for _, t in kept])
    assert sorted(i for i, _ in rows["SimHash near-dedup"]) == sorted({min(kept[j][0] for j in range(len(kept)) if lab[j] == k) for k in set(lab)})
    plain = lambda t: f" {' '.join(words(t))} "
    items = [plain(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    gone = {i for i, t in rows["SimHash near-dedup"] if any(x in plain(t) for x in items)}
    left = {i for i, _ in rows["benchmark decontamination"]}
    assert not gone & left and len({i for i, _ in rows["SimHash near-dedup"]} - gone - left) <= 2
    final = {r["doc_id"]: r["decoded_sha256"] for r in at["BPE"].collect()}
    assert final == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows["benchmark decontamination"]}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == left


def test_stages_keep_columns_with_clashing_names(spark, odd, nothing):
    """Columns named like internal ones pass through; documents without text or id are handled."""
    clash = odd.select("*", F.lit("x").alias("_id"), F.lit(1).alias("_sha"), F.lit("y").alias("text_sha256"), F.lit(2.5).alias("component_id"), F.lit("z").alias("id"))
    rows = pairs(clash)
    stay = {t: max((i for i, u in rows if (u or "") == t and i is not None), default=None) for t in {u or "" for _, u in rows}}
    got = corpus_pipeline.drop_copies(spark, clash, SF)
    assert got.columns == clash.columns and sorted(((i, t or "") for i, t in pairs(got)), key=repr) == sorted({(i, t or "") for i, t in rows if i == stay[t or ""]}, key=repr)
    near = corpus_pipeline.drop_near_copies(spark, clash, SF)
    assert near.columns == clash.columns
    order = lambda r: (r[0] is None, r[0], hashlib.sha256((r[1] or "").encode()).digest())
    ranked = sorted(rows, key=order)
    lab = brute_labels([brute_fingerprint(t) for _, t in ranked])
    assert sorted(((i, t or "") for i, t in pairs(near)), key=repr) == sorted(((ranked[k][0], ranked[k][1] or "") for k in set(lab)), key=repr)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_leaks):
        assert stage(spark, nothing, SF).count() == 0


def test_near_stage_keeps_one_row_of_repeated_and_null_ids(spark):
    rng = random.Random(5)
    t = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(999)) for _ in range(300)) for _ in range(5)]
    data = [(1, t[0]), (2, t[0] + " x"), (2, t[1]), (3, t[2]), (3, t[2]), (None, t[3]), (None, t[3] + " y"), (None, t[4]), (None, t[4])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for stages in ((corpus_pipeline.drop_near_copies,), (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies)):
        got = docs
        for stage in stages:
            got = stage(spark, got, SF)
        kept = pairs(got)
        assert sorted((i for i, _ in kept), key=repr) == [1, 2, 3, None, None]
        if stages[0] is corpus_pipeline.drop_copies:
            first = pairs(corpus_pipeline.drop_copies(spark, docs, SF))
            assert sorted(first, key=repr) == sorted(set(data), key=repr)
        assert {(1, t[0]), (2, t[1]), (3, t[2]), (None, t[4])} < set(kept) and ((None, t[3]) in kept) != ((None, t[3] + " y") in kept)


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
