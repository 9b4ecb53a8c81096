"""LM scoring (operator 4): an Elias-Fano n-gram trie.

A trigram model over words (A-Z lower-cased) and one end token a text, smoothed with Dirichlet priors and interpolated:
p(w | uv) = q(uvw) + g(uv) p(w | v), p(w | v) = q(vw) + g(v) p(w), p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), where
q(hw) = c(hw) / (c(h) + k) is the smoothed probability a trie level stores, quantised to a byte on a logarithmic scale, and
g(h) = k / (c(h) + k) the mass the prior leaves to the shorter context.  Two start tokens stand before a text.

Counts cover every training document and are 64 bits wide.  A trie level holds contexts, a monotone pointer sequence from
a context to its successors, and the successors, all three as Elias-Fano sequences, in one memory map with a byte for each
probability.  They are searched as they lie: the high bits by select over sampled counts, the low bytes in place, and a
successor by its low bytes within the pointer range of its context.

Documents are dealt into chunks, packed and compressed, and shuffled once; every later pass reads that shuffle.  For each
order in turn a chunk asks the shards of that order for its distinct n-grams, one packed row for each shard that has any,
along with its own training counts; a shard sums the counts of all chunks, builds its trie and answers from it.  A
request carries the count of the context, which the order before has answered, so a shard smooths by itself.  Shards are
dealt by n-gram, so no context gathers in one place.  N-grams whose context occurs in no other chunk need no request: the
chunk, which knows it from the counts of all texts, builds the trie of these itself.  Rows between chunks and shards never
outnumber the distinct n-grams of the chunks.

Cases: a null text is the empty text (one token, the end); ids may be null (crc of the empty text decides the fold)
or repeat; without training documents all counts are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomspan.llm import textops
from loomspan.llm.common import remainder, text_bytes, width

U64 = np.uint64
END, START, BEFORE = U64(0x8A5CD789635D2DFF), U64(0x121FD2155C472F96), U64(0x6C62272E07BB0142)
#: A key has 24 bits of its context and 24 of the whole n-gram, within a shard that 32 more bits choose: of the absent n-grams
#: a shard of 3 million is asked for, about one in 10**8 is taken for another.
_SUCCESSOR = U64(24)
_LOW_BITS = (U64(1) << _SUCCESSOR) - U64(1)
_STEPS = 254 / 48


#: Place of set bit number n (from 0) in a byte: 256 rows of 8.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.int64).ravel()
_ONES, _HIGH = U64(0x0101010101010101), U64(0x8080808080808080)


def _nth_bit(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of set bit number n (from 0) in each 64-bit word: bits up to each byte, the byte it falls in, its place there."""
    s = word - ((word >> U64(1)) & U64(0x5555555555555555))
    s = (s & U64(0x3333333333333333)) + ((s >> U64(2)) & U64(0x3333333333333333))
    s = ((s + (s >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
    n = n.astype(U64)
    before = np.bitwise_count((((n * _ONES) | _HIGH) - s) & _HIGH).astype(U64) * U64(8)
    rank = n - np.where(before > 0, (s >> (before - U64(8) * (before > 0).astype(U64))) & U64(0xFF), U64(0))
    return before.astype(np.int64) + _IN_BYTE[(((word >> before) & U64(0xFF)) * U64(8) + rank).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence: low bytes as they are, high parts in unary (element i of part p is set bit p + i), and the
    number of set bits before every 64.  Nothing is unpacked to be searched."""

    def __init__(self, n: int, nbytes: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.nbytes, self.low, self.high, self.ones = n, nbytes, low, high, ones
        self.shift, self.zeros = U64(8 * nbytes), None

    @classmethod
    def of(cls, values: np.ndarray, nbytes: int | None = None) -> EliasFano:
        """``nbytes`` are the low bytes of each value, about as many as leave two bits of high part a value if not given."""
        n = len(values)
        if not n:
            return cls(0, nbytes or 0, np.zeros((0, nbytes or 0), np.uint8), np.zeros(1, U64), np.zeros(2, np.int64))
        top = int(values[-1])
        if nbytes is None:
            nbytes = min(7, (max(0, (top // n).bit_length() - 1) + 3) // 8)
        part = (values >> U64(8 * nbytes)).astype(np.int64)
        bits = np.zeros(-(-(n + int(part[-1]) + 2) // 64) * 64, np.uint8)
        bits[part + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :nbytes].copy()
        return cls(n, nbytes, low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(i), U64), self.low[i]
        for k in range(self.nbytes):
            out |= rows[:, k].astype(U64) << U64(8 * k)
        return out

    def _part(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return word * 64 + _nth_bit(self.high[word], i - self.ones[word]) - i

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self._part(i).astype(U64) << self.shift) | self._low(i)

    def below(self, part: np.ndarray) -> np.ndarray:
        """Elements whose high part is below ``part``: what stands before the clear bit that ends part - 1."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones)) * 64 - self.ones
        zeros = self.zeros
        want = part - 1
        here = (want >= 0) & (want < zeros[-1])
        word = np.searchsorted(zeros, want[here], "right") - 1
        out = np.where(want < 0, 0, self.n)
        out[here] = np.minimum(word * 64 + _nth_bit(~self.high[word], want[here] - zeros[word]) - want[here], self.n)
        return out

    def _high(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(x >> self.shift, U64(1 << 62)).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that is at least x."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        part = self._high(x)
        return self._first(x & ((U64(1) << self.shift) - U64(1)), self.below(part), self.below(part + 1))

    def _first(self, low: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of the first element of [lo, hi), which share their high part, whose low part is at least ``low``."""
        a, b = lo.copy(), hi.copy()
        go = np.flatnonzero(a < b)
        while go.size:
            mid = (a[go] + b[go]) >> 1
            small = self._low(mid) < low[go]
            a[go[small]] = mid[small] + 1
            b[go[~small]] = mid[~small]
            go = go[a[go] < b[go]]
        return a

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each x, and whether it is there."""
        if self.n and not self.nbytes:
            # a set bit right after the clear bit that ends the part before says that there is one
            i = self.below(self._high(x))
            there = np.flatnonzero(i < self.n)
            bit = i[there].astype(U64) + x[there]
            out = np.zeros(len(x), bool)
            out[there] = self.high[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63)) & U64(1) > 0
            return i, out
        i = self.successor(x)
        there = i < self.n
        there[there] = self.at(i[there]) == x[there]
        return i, there

    def find_within(self, low: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same among the elements of [lo, hi), which share their high part; one element needs no search."""
        i, more = lo.copy(), np.flatnonzero(hi - lo > 1)
        i[more] = self._first(low[more], lo[more], hi[more])
        there = i < hi
        there[there] = self._low(i[there]) == low[there]
        return i, there


def quantise(p: np.ndarray) -> np.ndarray:
    """Probability to a code of 1 to 255 (0: none), even on a logarithmic scale down to 2**-48."""
    return np.where(p > 0, 1 + np.rint(-np.log2(np.clip(p, 2.0**-48, 1)) * _STEPS), 0).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], 2.0 ** (-np.arange(255) / _STEPS)])[codes]


class Trie:
    """The n-grams of one order and shard: quantised smoothed probabilities and counts, found by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, prior: float):
        """``keys`` ascend and differ, ``counts`` are positive, ``totals`` are the counts of the contexts."""
        context = keys >> _SUCCESSOR
        first = _runs(context)
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))).astype(U64)
        levels = [EliasFano.of(context[first]), EliasFano.of(np.append(first, len(keys)).astype(U64)), EliasFano.of((rank << _SUCCESSOR) | (keys & _LOW_BITS), 3)]
        arrays = [a for s in levels for a in s.arrays()] + [counts.astype(np.min_scalar_type(int(counts.max(initial=0)))), quantise(counts / (totals + prior))]
        self.map = mmap.mmap(-1, sum(a.nbytes + 8 for a in arrays) + 8)
        at, mapped = 0, []
        for a in arrays:
            view = np.frombuffer(self.map, a.dtype, a.size, at).reshape(a.shape)
            view[...] = a
            mapped.append(view)
            at += -(-a.nbytes // 8) * 8
        self.contexts, self.pointers, self.successors = (EliasFano(s.n, s.nbytes, *mapped[3 * i : 3 * i + 3]) for i, s in enumerate(levels))
        self.counts, self.codes = mapped[-2:]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and count of each key, ascending: the context, its pointer range, then the successor within that range."""
        codes, counts = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int64)
        context = keys >> _SUCCESSOR
        first = _runs(context)
        c, there = self.contexts.find(context[first])
        known, c = np.flatnonzero(there), c[there]
        if not len(known):
            return codes, counts
        ends = self.pointers.at(np.concatenate([c, c + 1])).astype(np.int64)
        size = np.diff(np.append(first, len(keys)))[known]
        at = np.repeat(first[known] - np.cumsum(size) + size, size) + np.arange(size.sum())
        spread = lambda x: np.repeat(x, size)
        i, there = self.successors.find_within(keys[at] & _LOW_BITS, spread(ends[: len(c)]), spread(ends[len(c) :]))
        codes[at[there]], counts[at[there]] = self.codes[i[there]], self.counts[i[there]]
        return codes, counts


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _squeeze(a: np.ndarray) -> bytes:
    """Integers byte by byte, lowest bytes first, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _loosen(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _pack(a: np.ndarray) -> bytes:
    """Ascending integers as differences."""
    return _squeeze(np.diff(a, prepend=U64(0)))


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(_loosen(b), dtype=U64)


class Grams(NamedTuple):
    """Distinct n-grams of a chunk: context (an index), key, what deals it to a shard, hash, count in training and in other
    texts; and the n-gram of every token."""

    context: np.ndarray
    key: np.ndarray
    deal: np.ndarray
    full: np.ndarray
    count: np.ndarray
    rest: np.ndarray
    of: np.ndarray


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, one end after each text, and the text of each."""
    hashes, texts, row = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    for _, _, buf, offsets in textops.slices(column):
        w = textops.find_words(textops.LOWER[buf], offsets)
        n = np.diff(w.first)
        out = np.full(len(w.starts) + len(n), END)
        out[np.arange(len(w.starts)) + np.repeat(np.arange(len(n)), n)] = textops.word_hashes(w)
        hashes.append(out)
        texts.append(np.repeat(np.arange(row, row + len(n)), n + 1))
        row += len(n)
    return np.concatenate(hashes), np.concatenate(texts)


class Chunk:
    """Tokens of some texts as numbers of the distinct words, and the n-grams that end at each."""

    def __init__(self, parts: list[dict]):
        self.ids, train, hashes, texts = [], [np.zeros(0, bool)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for p in parts:
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(p["sizes"], "<i8"))]).astype(np.int64)
            body = zstandard.ZstdDecompressor().decompress(p["texts"])
            column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
            h, t = tokens(column)
            hashes.append(h)
            texts.append(t + len(self.ids))
            self.ids += p["ids"]
            train.append(np.frombuffer(p["train"], bool))
        self.train, self.text = np.concatenate(train), np.concatenate(texts)
        self.words, self.word = _numbered(np.concatenate(hashes))
        self.made: dict[int, Grams] = {}
        self.weight = self.train[self.text].astype(np.float64)
        self.count, self.rest = self._counts(self.word, len(self.words))
        self.starts = np.flatnonzero(np.diff(self.text, prepend=-1))
        self.end = int(np.flatnonzero(self.words == END)[0])

    def _counts(self, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        train = np.bincount(of, self.weight, n).astype(np.int64)
        return train, np.bincount(of, minlength=n) - train

    def _previous(self, of: np.ndarray, none: int) -> np.ndarray:
        """What stands one token before, ``none`` before a text."""
        out = np.concatenate([[none], of[:-1]])[: len(of)]
        out[self.starts] = none
        return out

    def _grams(self, context: np.ndarray, hashes: np.ndarray) -> Grams:
        n = len(self.words)
        both, of = _numbered(context.astype(np.int64) * n + self.word)
        c, w = np.divmod(both, n)
        full = textops.mix(hashes[c] * U64(0x9E3779B97F4A7C15) + textops.mix(self.words[w]))
        key = ((textops.mix(hashes[c]) >> U64(40)) << _SUCCESSOR) | (full >> U64(40))
        return Grams(c, key, (full & U64(0xFFFFFFFF)).astype(np.int64), full, *self._counts(of, len(both)), of)

    def grams(self, order: int) -> Grams:
        if order not in self.made:
            if order == 2:
                self.made[2] = self._grams(self._previous(self.word, len(self.words)), np.append(self.words, START))
            else:
                two = self.grams(2)
                self.made[order] = self._grams(self._previous(two.of, len(two.full)), np.append(two.full, BEFORE))
        return self.made[order]


def _split(keys: np.ndarray, deal: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with any key, and the places of its keys in order."""
    shard = deal % shards
    if shards < 1 << 16 and len(keys) and int(keys.max()) < 1 << 48:  # keys of n-grams leave room for the shard
        order = np.argsort((shard.astype(U64) << U64(48)) | keys)
    else:
        order = np.argsort(keys)
        order = order[np.argsort(shard[order].astype(np.min_scalar_type(shards)), kind="stable")]
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of first occurrence, and the number of each value among them."""
    coded = pa.array(values.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).view(values.dtype), coded.indices.to_numpy(zero_copy_only=False)


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by group; exact, as 32 bits are summed at a time."""
    low = np.bincount(of, (values & 0xFFFFFFFF).astype(np.float64), n).astype(np.int64)
    return low + (np.bincount(of, (values >> 32).astype(np.float64), n).astype(np.int64) << 32)


def _answered(rows: list[dict], of_shard: list[tuple[int, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts (in training, in other texts) and codes in the order of the chunk's own n-grams."""
    counts, rests, codes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint8)
    got = {r["shard"]: r for r in rows}
    for s, at in of_shard:
        if got[s]["counts"]:
            counts[at], rests[at] = (_loosen(got[s][c]).astype(np.int64) for c in ("counts", "rests"))
        if got[s]["codes"]:
            codes[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(got[s]["codes"]), np.uint8)
    return counts, rests, codes


class Known(NamedTuple):
    """The n-grams of one order in a chunk with what is known of them."""

    grams: Grams
    total: np.ndarray
    asked: np.ndarray
    counts: np.ndarray
    codes: np.ndarray


class Scheme(NamedTuple):
    """How n-grams are dealt and smoothed."""

    shards: int
    order: int
    prior: float


def _knowledge(chunk: Chunk, row: dict, scheme: Scheme, upto: int, scoring: bool = False) -> tuple[np.ndarray, list[Known]]:
    """Word counts, and the n-grams of orders 2 to ``upto``; of the last one what is to be asked if ``row`` has no answers.
    Codes are only filled for ``scoring``."""
    counts, rests, _ = _answered(row["answers1"], list(_split(chunk.words, (chunk.words >> U64(3)).astype(np.int64), scheme.shards)), len(chunk.words))
    out: list[Known] = []
    # counts of the contexts, the start of a text last, which is met as often as the end
    here, everywhere = ([np.append(c, c[chunk.end]) for c in both] for both in ((chunk.count, chunk.rest), (counts, rests)))
    for order in range(2, upto + 1):
        g = chunk.grams(order)
        total = everywhere[0][g.context]
        own = (here[0] == everywhere[0])[g.context] & (here[1] == everywhere[1])[g.context] & (total > 0)
        asked = np.flatnonzero((total > 0) & ~own)
        n, rest, codes = np.where(own, g.count, 0), np.where(own, g.rest, 0), np.zeros(len(g.key), np.uint8)
        mine = np.flatnonzero(own)
        if row.get(f"answers{order}") is not None:
            shared = _split(g.key[asked], g.deal[asked], scheme.shards)
            n[asked], rest[asked], codes[asked] = _answered(row[f"answers{order}"], list(shared), len(asked))
            mine = mine[np.argsort(g.key[mine])] if scoring else mine
            trained = mine[g.count[mine] > 0]
            if scoring and len(trained):
                first = _runs(g.key[trained])
                trie = Trie(g.key[trained[first]], np.add.reduceat(g.count[trained], first), total[trained[first]], scheme.prior)
                codes[mine] = trie.look_up(g.key[mine])[0]
        out.append(Known(g, total, asked, n, codes))
        here, everywhere = ([np.append(c, e[-1]) for c, e in zip(now, before, strict=True)] for now, before in (((g.count, g.rest), here), ((n, rest), everywhere)))
    return counts, out


_REQUEST = "shard int, chunk int, keys binary, counts binary, rests binary, totals binary"


def _request_rows(chunk: int, rows: list[tuple]) -> pa.Table:
    shard, *packed = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.table([pa.array(shard, pa.int32()), pa.array([chunk] * len(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["shard", "chunk", "keys", "counts", "rests", "totals"])


def _ask(order: int, scheme: Scheme):
    """One chunk: what it asks the shards of an order."""

    def run(table: pa.Table) -> pa.Table:
        (row,) = table.to_pylist()
        chunk = Chunk(row["parts"])
        if order == 1:
            parts = _split(chunk.words, (chunk.words >> U64(3)).astype(np.int64), scheme.shards)
            return _request_rows(row["chunk"], [(s, _pack(chunk.words[at]), _squeeze(chunk.count[at]), _squeeze(chunk.rest[at]), b"") for s, at in parts])
        g, total, asked, *_ = _knowledge(chunk, row, scheme, order)[1][-1]
        key, deal, count, rest, total = g.key[asked], g.deal[asked], g.count[asked], g.rest[asked], total[asked]
        last = order == scheme.order
        return _request_rows(row["chunk"], [(s, _pack(key[at]), _squeeze(count[at]), b"" if last else _squeeze(rest[at]), _squeeze(total[at])) for s, at in _split(key, deal, scheme.shards)])

    return run


def _answer(order: int, scheme: Scheme):
    """One shard: sum the counts, build the trie, look every request up in it.  Of words it also says, in one row, how many
    training tokens (n) and how many different ones (v) it holds."""

    def run(asked: pa.Table) -> pa.Table:
        keys = [_unpack(b) for b in asked.column("keys").to_pylist()]
        read = lambda c: np.concatenate([_loosen(b).astype(np.int64) for b in asked.column(c).to_pylist()])
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
        k, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        back = lambda values, pack: [pack(values[of[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        none, last = [b""] * len(keys), order == scheme.order
        count = _sums(of, read("counts"), len(k))
        codes = none
        if order > 1:
            total, some = read("totals")[first], count > 0
            code, count = Trie(k[some], count[some], total[some], scheme.prior).look_up(k)
            codes = back(code, lambda x: zstandard.ZstdCompressor(level=1).compress(x.tobytes()))
        known = (k[:0], 0) if order > 1 else (k[count > 0], int(count.sum()))
        # held-out texts ask too: what they hold only tells a chunk whether it is alone with a context
        columns = [none, none, codes] if last else [back(count, _squeeze), back(_sums(of, read("rests"), len(k)), _squeeze), codes]
        first_row = [i == 0 for i in range(len(keys))]
        sums = [pa.array([x if f else 0 for f in first_row], pa.int64()) for x in (known[1], len(known[0]))]
        return pa.table([asked.column("chunk"), asked.column("shard"), *(pa.array(x, pa.binary()) for x in columns), *sums], names=["chunk", "shard", "counts", "rests", "codes", "n", "v"])

    return run


def _score(scheme: Scheme, id_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        (row,) = table.to_pylist()
        total, distinct = row["n"], row["v"]
        chunk = Chunk(row["parts"])
        counts, known = _knowledge(chunk, row, scheme, scheme.order, scoring=True)
        c = counts[chunk.word]
        alone = (c + 0.1) / (total + 0.1 * (distinct + 1))
        model = alone
        for k in known:
            context = k.total[k.grams.of]
            model = dequantise(k.codes)[k.grams.of] + scheme.prior / (context + scheme.prior) * model
        n = len(chunk.ids)
        sums = lambda x: np.bincount(chunk.text, x, n)
        whole = lambda x: pa.array(sums(x).astype(np.int64))
        score, many = sums(np.log10(np.minimum(model, 1))), sums(np.ones(len(c)))
        return pa.table(
            [pa.array(chunk.ids, id_type), pa.array(~chunk.train), pa.array(many.astype(np.int64)), whole(c > 0), pa.array(np.full(n, total), pa.int64()), pa.array(sums(np.log10(alone))), pa.array(score), pa.array(score / many)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "score_per_token"],
        )

    return run


def _packing(chunks: int, most: int = 32 << 20):
    """Map side: texts of one task by chunk, compressed, in rows for at most ``most`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["chunk", "ids", "train", "sizes", "texts"]

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            chunk = t.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
                some = t.take(pa.array(at))
                buf, offsets = textops.buffers(some.column("text"))
                texts = zstandard.ZstdCompressor(level=3).compress(buf.tobytes())
                ids = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), some.column("doc_id").combine_chunks())
                train = some.column("train").to_numpy().astype(bool).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk[at[0]])], pa.int32()), ids, *(pa.array([x], pa.binary()) for x in (train, np.diff(offsets).astype("<i8").tobytes(), texts))], names=names)

        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) > most:
                yield from out()
                held = []
        if held and sum(b.num_rows for b in held):
            yield from out()

    return run


def dealt(docs: DataFrame, folds: int, held: int, chunks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, train, chunk.  A row's place in its input partition is part of what deals it, so rows that repeat text and id
    are spread like all others; a partition that is read again gives the same rows in the same places."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (remainder(F.col(id_col), folds) != held).alias("train"),
        F.pmod(F.xxhash64(F.col(text_col), F.col(id_col), F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"),
    )


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0, prior: float = 20.0, order: int = 3, chunk_bytes: int = 8 << 20, shard_bytes: int = 20 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), score_per_token.

    ``chunk_bytes`` of text, and the n-grams of about ``shard_bytes`` of text, are what one task holds at a time.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    n, size = width(docs.sparkSession), text_bytes(docs, text_col)
    chunks = max(-(-size // chunk_bytes), min(n, -(-size // (1 << 20))), 1)
    rows = dealt(docs, folds, held, chunks, id_col, text_col)
    scheme = Scheme(max(-(-size // shard_bytes), min(n, -(-size // (1 << 20))), 1), order, prior)
    id_type = dict(rows.dtypes)["doc_id"]
    packed = rows.mapInArrow(_packing(chunks), f"chunk int, ids array<{id_type}>, train binary, sizes binary, texts binary")
    known = packed.repartition(n, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("ids", "train", "sizes", "texts")).alias("parts"))
    totals = None
    for k in range(1, order + 1):
        asked = known.groupBy("chunk").applyInArrow(_ask(k, scheme), _REQUEST)
        answered = asked.repartition(n, "shard").groupBy("shard").applyInArrow(_answer(k, scheme), "chunk int, shard int, counts binary, rests binary, codes binary, n long, v long")
        totals = answered.agg(F.sum("n").alias("n"), F.sum("v").alias("v")) if k == 1 else totals
        by_chunk = answered.repartition(n, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("shard", "counts", "rests", "codes")).alias(f"answers{k}"))
        known = known.join(by_chunk, "chunk", "left").withColumn(f"answers{k}", F.coalesce(f"answers{k}", F.array()))
    arrow_type = to_arrow_type(rows.schema["doc_id"].dataType)
    # N and V are one row, sent to every task
    return known.crossJoin(F.broadcast(totals)).groupBy("chunk").applyInArrow(
        _score(scheme, arrow_type), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double"
    )
