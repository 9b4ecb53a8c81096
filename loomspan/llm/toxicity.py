"""Toxicity (operator 3): a bidirectional gated recurrent network with attention pooling, trained in numpy.

Word input: five learned vectors, one for the word and four for its stem and ending (its first four, six and seven bytes
and its last three, all lower-cased and hashed into tables).  Character input: every three bytes in a row pass learned
filters, each filter's highest response over the word enters, so a word is read byte by byte whatever its length.
The sum of both runs through a forward and a backward GRU.  Every window of ``SPAN`` consecutive words, one starting at
each word, is pooled by attention and scored by a logistic output; a text's score is that of its highest window.
Windows share the states: a state is that of a GRU started at the block of ``BLOCK`` words before its own block, so it has
read the 8 to 15 words before its own, those beyond the window's edge included; training runs the same recurrence.  The
two sums of the attention come from running totals, so all overlapping windows cost no more than the words.

Training is multiple-instance: of a toxic text one window is the positive example, at first that around the word most
telling for the class, later, twice, the window the network itself scores highest; of other texts random windows and
those scored highest so far are negative.  At most ``fit_rows`` labelled rows
of at most ``fit_chars`` characters are used; scoring reads whole texts.

Cases: a null or empty text is scored as one empty window; ids may be null or repeat; without both classes in the
sample all scores are the share of class 1 (0 with no labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textops
from loomspan.llm.common import remainder
from loomspan.llm.sampling import labelled_sample

SPAN, STRIDE, BLOCK = 32, 16, 8
#: Blocks that a window may touch.
BLOCKS = SPAN // BLOCK + 1
BUCKETS, DEPTH, HIDDEN = 1 << 15, 8, 8
_FEATURES = 5
#: Filters over three bytes.
FILTERS = 12
#: Share of words hidden in training from the table of whole words, from that of their first seven bytes and from the filters.
HIDE = {0: 0.7, 3: 0.3, _FEATURES: 0.3}


class Letters(NamedTuple):
    """Byte strings of distinct words, one after the other: word i has ``begin[i]`` to ``begin[i + 1]``; word 0 is none."""

    flat: np.ndarray
    begin: np.ndarray

    def some(self, which: np.ndarray) -> Letters:
        size = self.begin[which + 1] - self.begin[which]
        begin = np.concatenate([[0], np.cumsum(size)])
        return Letters(self.flat[np.repeat(self.begin[which] - begin[:-1], size) + np.arange(begin[-1])], begin)

    def threes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte before, byte and byte after of every place; 0 outside the word."""
        before, after = np.zeros_like(self.flat), np.zeros_like(self.flat)
        before[1:], after[:-1] = self.flat[:-1], self.flat[1:]
        before[self.begin[:-1][self.begin[:-1] < len(before)]] = 0
        after[self.begin[1:][self.begin[1:] > 0] - 1] = 0
        return before, self.flat, after


def word_features(words: textops.Words) -> tuple[np.ndarray, Letters]:
    """Rows of the five tables and number among the distinct words for every word (words x 6; 0: no word), their bytes."""
    buf = textops.LOWER[words.buf]
    core = ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57)) | (buf >= 128)
    at = np.flatnonzero(core)
    lo, hi = np.searchsorted(at, words.starts), np.searchsorted(at, words.ends)
    some = hi > lo
    start, end = words.starts.copy(), words.ends.copy()
    start[some], end[some] = at[lo[some]], at[hi[some] - 1] + 1
    out = np.empty((len(start), _FEATURES + 1), np.int32)
    ranges = ((start, end), (start, np.minimum(start + 4, end)), (start, np.minimum(start + 6, end)), (start, np.minimum(start + 7, end)), (np.maximum(end - 3, start), end))
    for i, (s, e) in enumerate(ranges):
        h = textops.hash_ranges(buf, s, e)
        out[:, i] = (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 + i * BUCKETS
        if not i:
            _, one, number = np.unique(h, return_index=True, return_inverse=True)
            out[:, _FEATURES] = number + 1
    begin = np.concatenate([[0, 0], np.cumsum(end[one] - start[one])])
    letters = Letters(buf[np.repeat(start[one] - begin[1:-1], end[one] - start[one]) + np.arange(begin[-1])], begin)
    return out, letters


def all_features(column: pa.Array, most: int = 1 << 20) -> tuple[np.ndarray, Letters, np.ndarray]:
    """``word_features`` of all texts of a column, found slice by slice (a word has a number in each slice that holds it), and where
    each text's words start.  A last row stands for no word."""
    rows, some, first = [], [], [np.zeros(1, np.int64)]
    for _, _, buf, offsets in textops.slices(column, most):
        words = textops.find_words(buf, offsets)
        found, letters = word_features(words)
        rows.append(found)
        some.append(letters)
        first.append(first[-1][-1] + words.first[1:])
    size = sum(map(len, rows))
    out = np.zeros((size + 1, _FEATURES + 1), np.int32)
    bytes_, begin, number, at = [np.zeros(0, np.uint8)], [np.zeros(2, np.int64)], 0, 0
    for r, letters in zip(rows, some):
        out[at : at + len(r)] = r
        part = out[at : at + len(r), _FEATURES]
        part[part > 0] += number
        bytes_.append(letters.flat)
        begin.append(begin[-1][-1] + letters.begin[2:])
        number, at = number + len(letters.begin) - 2, at + len(r)
    return out, Letters(np.concatenate(bytes_), np.concatenate(begin)), np.concatenate(first)


def windows(n: np.ndarray, span: int = SPAN, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of every window, for texts of n words each; every text has one at least."""
    many = np.maximum(1, -(-(n - span) // stride) + 1)
    text = np.repeat(np.arange(len(n)), many)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * stride


class Windows(NamedTuple):
    """Windows laid out as the states are read: for either direction the words of the blocks a window touches and of the one before.

    ``rows``: windows x 2 x words x 6 features; ``mask``: which of them are words of the text; ``place``: where among the words of
    the blocks after the first each word of the window stands (windows x 2 x span); ``real``: windows x span, words of the
    text; ``at``: windows x 2 x words, positions in the text.
    """

    rows: np.ndarray
    mask: np.ndarray
    place: np.ndarray
    real: np.ndarray
    at: np.ndarray

    def some(self, i: np.ndarray) -> Windows:
        return Windows(*(x[i] for x in self))


def _gather(rows: np.ndarray, first: np.ndarray, n: np.ndarray, text: np.ndarray, at: np.ndarray) -> Windows:
    """Windows from words ``at`` of texts; the last of ``rows`` stands for what is beyond a text.  The backward direction counts
    words, and blocks, from the end of the text."""
    size = n[text]
    begin = np.stack([at, size - at - SPAN], 1)  # first word of the window, in either direction
    block = begin // BLOCK - 1
    pos = (block * BLOCK)[:, :, None] + np.arange((BLOCKS + 1) * BLOCK)
    mask = (pos >= 0) & (pos < size[:, None, None])
    pos = np.stack([pos[:, 0], size[:, None] - 1 - pos[:, 1]], 1)
    span = at[:, None] + np.arange(SPAN)
    own = np.stack([span, size[:, None] - 1 - span], 1) - ((block + 1) * BLOCK)[:, :, None]
    index = np.where(mask, first[text][:, None, None] + pos, len(rows) - 1)
    return Windows(rows[index], mask, own, span < size[:, None], pos)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _sums(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group; the groups are sorted once for all columns."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(rows):
        order = np.argsort(of, kind="stable")
        at = np.flatnonzero(np.diff(of[order], prepend=-1))
        out[of[order[at]]] = np.add.reduceat(rows[order], at, axis=0)
    return out


class Network:
    """Weights: table (5 BUCKETS x DEPTH), byte filters T (3 x 256 x FILTERS) and P (FILTERS x DEPTH), per direction W (DEPTH x
    3 HIDDEN), U, b; attention A, v; output o, c."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2] if len(s) > 1 else s[0]), s).astype(np.float32)
        self.p = {
            "table": rng.normal(0, 0.1, (_FEATURES * BUCKETS, DEPTH)).astype(np.float32),
            "T": rng.normal(0, 0.3, (3, 256, FILTERS)).astype(np.float32), "P": (0.1 * draw(FILTERS, DEPTH)).astype(np.float32),
            "W": draw(2, DEPTH, 3 * HIDDEN), "U": draw(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32),
            "A": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN), "o": draw(2 * HIDDEN), "c": np.zeros(1, np.float32),
        }
        self.prior: float | None = None

    def read(self, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Highest response of every filter over each word (0 for a word of no bytes), and all responses."""
        threes, size = letters.threes(), np.diff(letters.begin)
        all_of = sum(self.p["T"][k][b] for k, b in enumerate(threes))
        best, some = np.zeros((len(size), FILTERS), self.p["T"].dtype), np.flatnonzero(size)
        if len(some):
            best[some] = np.maximum.reduceat(all_of, letters.begin[some], axis=0)
        return np.tanh(best), all_of

    def spelled(self, letters: Letters, most: int = 1 << 14) -> np.ndarray:
        """What the bytes of each distinct word add to its input; nothing for no word."""
        size = len(letters.begin) - 1
        parts = [self.read(letters.some(np.arange(i, min(i + most, size))))[0] @ self.p["P"] for i in range(0, size, most)]
        out = np.concatenate(parts)
        out[0] = 0
        return out

    def inputs(self, rows: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Input vectors of words from their table rows and what ``spelled`` says of their bytes."""
        x = spelled[rows[..., _FEATURES]]
        for i in range(_FEATURES):
            x = x + self.p["table"][rows[..., i]]
        return x

    def forward(self, some: Windows, letters: Letters, keep: bool = False):
        """Logit of every window from states as ``states`` gives them; with ``keep`` also what the backward pass needs."""
        p, n, H = self.p, len(some.rows), HIDDEN
        used, place = np.unique(some.rows[..., _FEATURES], return_inverse=True)
        few = letters.some(used)
        best, responses = self.read(few)
        there = (used > 0)[:, None]
        x = ((best @ p["P"]) * there)[place.reshape(some.mask.shape)]
        for i in range(_FEATURES):
            x = x + p["table"][some.rows[..., i]]
        every = np.zeros((n, SPAN, 2 * H), x.dtype)
        cache = []
        for d in (0, 1):
            gx = (x[:, d].reshape(-1, DEPTH) @ p["W"][d] + p["b"][d]).reshape(n, BLOCKS + 1, BLOCK, 3 * H)
            live = some.mask[:, d].reshape(n, BLOCKS + 1, BLOCK, 1)
            h, out = np.zeros((n, BLOCKS, H), x.dtype), np.zeros((n, BLOCKS, BLOCK, H), x.dtype)
            for t in range(2 * BLOCK):  # all blocks side by side: the words of the block before, then its own
                g, m = (v[:, t // BLOCK : t // BLOCK + BLOCKS, t % BLOCK] for v in (gx, live))
                gu = h @ p["U"][d]
                zr = _sigmoid(g[..., : 2 * H] + gu[..., : 2 * H])
                z, r = zr[..., :H], zr[..., H:]
                c = np.tanh(g[..., 2 * H :] + r * gu[..., 2 * H :])
                if keep:
                    cache.append((d, t, m, h, z, r, c, gu[..., 2 * H :]))
                h = np.where(m, z * h + (1 - z) * c, h)
                if t >= BLOCK:
                    out[:, :, t - BLOCK] = h
            every[..., d * H : (d + 1) * H] = np.take_along_axis(out.reshape(n, -1, H), some.place[:, d, :, None], 1)
        a = np.tanh(every.reshape(-1, 2 * H) @ p["A"]).reshape(n, SPAN, H)
        e = np.where(some.real, a @ p["v"], -1e9)
        e = e - e.max(1, keepdims=True)
        w = np.exp(e) * some.real
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = (w[:, None, :] @ every)[:, 0]
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (x, every, cache, a, w, pooled, few, place, there, best, responses)) if keep else logit

    def gradients(self, some: Windows, y: np.ndarray, letters: Letters) -> dict[str, np.ndarray]:
        p, H, n = self.p, HIDDEN, len(some.rows)
        logit, (x, every, cache, a, w, pooled, few, place, there, best, responses) = self.forward(some, letters, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k != "table"}
        dl = ((_sigmoid(logit) - y) / n).astype(x.dtype)
        g["o"], g["c"] = pooled.T @ dl, np.array([dl.sum()], x.dtype)
        dp = dl[:, None] * p["o"]
        ds = w[:, :, None] * dp[:, None, :]
        dw = (every @ dp[:, :, None])[:, :, 0]
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["v"] = (a * de[:, :, None]).sum((0, 1))
        da = de[:, :, None] * p["v"] * (1 - a**2)
        g["A"] = every.reshape(-1, 2 * H).T @ da.reshape(-1, H)
        ds += da @ p["A"].T
        dx = np.zeros((n, 2, BLOCKS + 1, BLOCK, DEPTH), x.dtype)
        back, dh = {}, {}
        for d in (0, 1):
            back[d] = np.zeros((n, BLOCKS * BLOCK, H), x.dtype)
            np.put_along_axis(back[d], some.place[:, d, :, None], ds[..., d * H : (d + 1) * H], 1)
            back[d] = back[d].reshape(n, BLOCKS, BLOCK, H)
        by_block = x.reshape(dx.shape)
        flat = lambda v: v.reshape(-1, v.shape[-1])
        for d, t, m, h, z, r, c, uc in reversed(cache):
            dn = dh.get(d, 0) + (back[d][:, :, t - BLOCK] if t >= BLOCK else 0)
            live = dn * m
            dz, dc = live * (h - c), live * (1 - z)
            dc = dc * (1 - c**2)
            dr = dc * uc
            gate = np.concatenate([dz * z * (1 - z), dr * r * (1 - r)], -1)
            gx = np.concatenate([gate, dc], -1)
            gu = np.concatenate([gate, dc * r], -1)
            blocks = slice(t // BLOCK, t // BLOCK + BLOCKS)
            g["W"][d] += flat(by_block[:, d, blocks, t % BLOCK]).T @ flat(gx)
            g["b"][d] += gx.sum((0, 1))
            g["U"][d] += flat(h).T @ flat(gu)
            dx[:, d, blocks, t % BLOCK] += gx @ p["W"][d].T
            dh[d] = np.where(m, live * z, dn) + gu @ p["U"][d].T
        spelled = _sums(place.ravel(), dx.reshape(-1, DEPTH), len(best)) * there
        g["P"] = best.T @ spelled
        size = np.diff(few.begin)
        word = np.repeat(np.arange(len(size)), size)
        # a filter's gradient goes to the places of its highest response, in equal shares
        top = np.tanh(responses) == best[word]
        share, spelt = np.zeros_like(best), np.flatnonzero(size)
        if len(spelt):
            share[spelt] = np.add.reduceat(top, few.begin[spelt], axis=0, dtype=best.dtype)
        each = top * ((spelled @ p["P"].T) * (1 - best**2) / np.maximum(share, 1))[word]
        for k, b in enumerate(few.threes()):
            g["T"][k] = _sums(b, each, 256)
        used, group = np.unique(some.rows[..., :_FEATURES], return_inverse=True)
        grad = _sums(group.reshape(-1), np.repeat(dx.reshape(-1, DEPTH), _FEATURES, 0), len(used))
        grad[used == 0] = 0
        g["table"] = (used, grad)
        return g

    def train(self, some: Windows, y: np.ndarray, letters: Letters, passes: int, rate: float, rng: np.random.Generator, size: int = 64) -> None:
        """Adam; the table's moments are kept for touched rows only.  In each batch words are hidden from the table of whole
        words and others from the filters, so that neither learns a word by heart."""
        if not hasattr(self, "m"):
            self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
            self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
            self.step = 0
        for _ in range(passes):
            order = rng.permutation(len(y))
            for begin in range(0, len(y), size):
                i = order[begin : begin + size]
                self.step += 1
                seen = some.some(i)
                for column, share in HIDE.items():  # a word is hidden from both directions alike
                    draw = rng.random((len(i), 256)) < share
                    seen.rows[..., column][np.take_along_axis(draw, (seen.at % 256).reshape(len(i), -1), 1).reshape(seen.at.shape)] = 0
                for k, grad in self.gradients(seen, y[i], letters).items():
                    where, grad = grad if k == "table" else (slice(None), grad)
                    m = self.m[k][where] = 0.9 * self.m[k][where] + 0.1 * grad
                    s = self.s[k][where] = 0.99 * self.s[k][where] + 0.01 * grad**2
                    self.p[k][where] -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-6)


def states(net: Network, x: np.ndarray, starts: np.ndarray, d: int, most: int = 4096) -> np.ndarray:
    """State after each word in direction ``d`` (0 forward, 1 backward), of a GRU that starts with the block of BLOCK
    words before the word's own (with the text, in its first block).  Short histories do better on held-out rows than long ones."""
    p, H = net.p, HIDDEN
    gx = x @ p["W"][d] + p["b"][d]
    out = np.zeros((len(x), H), np.float32)
    n, first = np.diff(starts), starts[:-1]
    blocks = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), blocks)
    block = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    for warm in (0, BLOCK):
        those = np.flatnonzero(block > 0 if warm else block == 0)
        for at in range(0, len(those), most):
            t, b = text[those[at : at + most]], block[those[at : at + most]]
            h = np.zeros((len(t), H), np.float32)
            for step in range(-warm, BLOCK):
                pos = b * BLOCK + step
                inside = pos < n[t]
                index = first[t] + np.where(d == 0, np.minimum(pos, n[t] - 1), np.maximum(n[t] - 1 - pos, 0))
                g, gu = gx[index], h @ p["U"][d]
                zr = _sigmoid(g[:, : 2 * H] + gu[:, : 2 * H])
                h = zr[:, :H] * h + (1 - zr[:, :H]) * np.tanh(g[:, 2 * H :] + zr[:, H:] * gu[:, 2 * H :])
                if step >= 0:
                    out[index[inside]] = h[inside]
    return out


def readings(net: Network, rows: np.ndarray, spelled: np.ndarray, starts: np.ndarray, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Attention (not yet normalised) of every word and what its state says for the class; text i has words ``starts[i]`` to
    ``starts[i + 1]``.  Texts are taken in runs of about ``most`` words, so that little is held beside the answer."""
    p = net.p
    attention, says, i = np.empty(len(rows)), np.empty(len(rows), np.float32), 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
        run = slice(starts[i], starts[j])
        x = net.inputs(rows[run], spelled)
        s = np.concatenate([states(net, x, starts[i : j + 1] - starts[i], d) for d in (0, 1)], 1)
        attention[run], says[run] = np.exp((np.tanh(s @ p["A"]) @ p["v"]).astype(np.float64)), s @ p["o"]
        i = j
    return attention, says


def window_logits(net: Network, attention: np.ndarray, says: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Logit of the windows of words begin to end (exclusive; none: the bias alone), from running totals."""
    weight, pooled = (c[end] - c[begin] for c in (np.concatenate([[0.0], np.cumsum(x)]) for x in (attention, attention * says)))
    return np.where(end > begin, pooled / np.maximum(weight, 1e-12), 0) + net.p["c"][0]


def text_scores(net: Network, words: textops.Words) -> np.ndarray:
    """Probability of the highest of all windows of every text."""
    n = np.diff(words.first)
    if not len(n):
        return np.zeros(0)
    many = np.maximum(1, n - SPAN + 1)
    text = np.repeat(np.arange(len(n)), many)
    begin = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    rows, letters = word_features(words)
    logit = window_logits(net, *readings(net, rows, net.spelled(letters), words.first), begin, np.minimum(begin + SPAN, words.first[text + 1]))
    return _sigmoid(np.maximum.reduceat(logit, np.cumsum(many) - many))


def fit(sample: list[tuple[str, int]], negatives: int = 2, seed: int = 5, turns: int = 8, examples: int = 10_240) -> Network:
    """Train on a sample of (text, label), in each turn on about ``examples`` windows (several passes where there are fewer)."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array([c for _, c in sample], np.float32)
    if not 0 < y.sum() < len(y):
        net.prior = float(y.mean()) if len(y) else 0.0
        return net
    padded, letters, first = all_features(pa.array([t for t, _ in sample], pa.large_string()))
    rows, n = padded[:-1], np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    # how telling each table row is: log odds of texts that hold it, smoothed
    pos, neg = np.zeros(_FEATURES * BUCKETS), np.zeros(_FEATURES * BUCKETS)
    for f in range(_FEATURES):
        text, row = np.divmod(np.unique(owner * (_FEATURES * BUCKETS) + rows[:, f]), _FEATURES * BUCKETS)
        pos += np.bincount(row[y[text] == 1], minlength=len(pos))
        neg += np.bincount(row[y[text] == 0], minlength=len(neg))
    odds = np.log((pos + 0.1) / (y.sum() + 1)) - np.log((neg + 0.5) / (len(y) - y.sum() + 1))
    odds = np.where(pos + neg > 1, odds, 0).astype(np.float32)
    telling = odds[rows[:, 0]]
    for f in range(1, _FEATURES):
        np.maximum(telling, odds[rows[:, f]], out=telling)
    del owner, pos, neg
    text, at = windows(n)
    toxic = np.flatnonzero((y == 1) & (n > 0))
    if not len(toxic):  # toxic texts without a word teach nothing
        net.prior = float(y.mean())
        return net
    best = np.array([telling[first[i] : first[i + 1]].argmax() for i in toxic])
    clean = np.flatnonzero(y[text] == 0)
    most = max(1, examples // (1 + 4 * negatives))

    def batch(starts: np.ndarray) -> tuple[Windows, np.ndarray, Letters]:
        some = np.sort(rng.permutation(len(toxic))[:most])
        other = rng.choice(clean, min(len(clean), negatives * 3 * len(some)), replace=False)
        hard = clean[np.argsort(-logits)[: negatives * len(some)]] if logits is not None else other[:0]
        t = np.concatenate([toxic[some], text[other], text[hard]])
        a = np.concatenate([starts[some], at[other], at[hard]])
        return _gather(padded, first, n, t, a), y[t], letters

    logits = None
    for turn in range(turns):
        # the word moves about in its window, so that no position is learned by heart
        starts = np.maximum(0, np.minimum(best - rng.integers(0, SPAN, len(best)), n[toxic] - 1))
        starts = np.minimum(starts, best)
        chosen = batch(starts)
        net.train(*chosen, passes=max(1, round(examples / len(chosen[1]))), rate=0.01 if turn < 5 else 0.003, rng=rng)
        if turn in (2, 5):
            attention, says = readings(net, rows, net.spelled(letters), first)
            begin = first[text[clean]] + at[clean]
            logits = window_logits(net, attention, says, begin, np.minimum(begin + SPAN, first[text[clean] + 1]))
            best = np.array([elected(net, attention[a:b], says[a:b]) for a, b in zip(first[toxic], first[toxic + 1])])
    return net


def elected(net: Network, attention: np.ndarray, says: np.ndarray) -> int:
    """The word that counts most in the highest window of one text."""
    begin = np.arange(max(1, len(says) - SPAN + 1))
    at = int(window_logits(net, attention, says, begin, np.minimum(begin + SPAN, len(says))).argmax())
    return at + int((attention * says)[at : at + SPAN].argmax())


def _weights(net: Network) -> dict:
    """What is sent to the tasks: about 3 MB, whatever the sample."""
    return {"prior": net.prior, **{k: v.astype(np.float16) if k == "table" else v for k, v in net.p.items()}}


def _restored(weights: dict) -> Network:
    net = Network.__new__(Network)
    net.prior, net.p = weights["prior"], {k: v.astype(np.float32) for k, v in weights.items() if k != "prior"}
    return net


def batch_scores(net: Network, column: pa.Array) -> np.ndarray:
    if net.prior is not None:
        return np.full(len(column), net.prior)
    out = np.empty(len(column))
    for begin, end, buf, offsets in textops.slices(column, 1 << 20):
        out[begin:end] = text_scores(net, textops.find_words(buf, offsets))
    return out


def score_toxicity(docs: DataFrame, net: Network, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted."""
    weights = docs.sparkSession.sparkContext.broadcast(_weights(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _restored(weights.value)
        for b in batches:
            score = batch_scores(model, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Network, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; rows pass through, nothing is joined."""
    weights = docs.sparkSession.sparkContext.broadcast(_weights(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _restored(weights.value)
        for b in batches:
            yield b.filter(pa.array(batch_scores(model, b.column(text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, fit_chars: int = 20_000, folds: int = 3, held: int = 1) -> Network:
    return fit(labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), folds) != held, fit_rows, fit_chars)[0])


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """Fit on labelled rows outside the held-out fold and score all documents; adds held_out."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, folds=folds, held=held, **options))
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
