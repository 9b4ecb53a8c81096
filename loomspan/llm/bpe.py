"""BPE encoding and decoding (operator 10): a segment tree over adjacent pair ranks.

Every pre-token is a row of symbols.  Leaf i of its segment tree holds ``rank * width + i`` of the pair that starts at
symbol i, so the root is the lowest rank and, among equals, the leftmost pair.  One merge changes three leaves, each
re-aggregated along its path to the root; merging ends when the root holds no mergeable pair.  Many pre-tokens are
merged side by side: a tree is one row of a matrix, and a step merges the root pair of every row that still has one.
In a pre-token of over ``LONG`` bytes a step merges all pairs of the root's rank, found from the root down, where the
vocabulary makes no pair of a new symbol rank before the pair that made it; else they too go one by one.

The vocabulary is read from a ``tokenizers`` JSON file (its path is a parameter); nothing is trained.  Special tokens
in a text become their own ids, as the library does when ``encode_special_tokens`` is left off.

Cases: a null text is the empty text (no ids, empty decoding); ids repeat if rows do; null document ids pass through;
an empty table gives no rows; columns other than the two named are ignored.  Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textops

#: The pattern that splits a text before merging, as the byte-level vocabularies define it (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int64(1 << 62)
LONG = 512


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


class Vocabulary:
    """Ids, pair ranks and byte strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in ids.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.byte_id = np.array([ids[c] for c in chars], np.int64)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.shift = np.int64(len(self.table))
        key = np.array([a * len(self.table) + b for a, b, _ in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], order.astype(np.int64), np.array([m for *_, m in pairs], np.int64)
        made = np.full(len(self.table), -1, np.int64)
        np.maximum.at(made, self.merged, np.arange(len(pairs)))
        parts = np.array([(a, b) for a, b, _ in pairs], np.int64).reshape(-1, 2)
        self.in_order = bool((made[parts].max(1) < np.arange(len(pairs))).all())
        self.slots = 1 << 19
        self.slot = self._hashed()
        self.split = regex.compile(SPLIT)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _hashed(self) -> np.ndarray:
        """Open-addressed table from pair to its index among the sorted keys."""
        slot = np.full(self.slots, -1, np.int64)
        todo, at = np.arange(len(self.key)), self._place(self.key)
        while len(todo):
            free = slot[at] < 0
            slot[at[free]] = todo[free]
            left = slot[at] != todo
            todo, at = todo[left], (at[left] + 1) % self.slots
        return slot

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a * self.shift + b
        out = np.full(len(key), -1, np.int64)
        todo, at = np.arange(len(key)), self._place(key)
        while len(todo):
            there = self.slot[at]
            hit = (there >= 0) & (self.key[there] == key[todo])
            out[todo[hit]] = self.rank[there[hit]]
            go = (there >= 0) & ~hit
            todo, at = todo[go], (at[go] + 1) % self.slots
        return out

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merge rows of equal length (rows x symbols) to the end; cells that hold no symbol any more are -1."""
        rows, n = symbols.shape
        if n < 2:
            return symbols
        if n > LONG and self.in_order:
            return np.stack([self.merge_long(row) for row in symbols])
        width = 1 << (n - 1).bit_length()
        sym = symbols.copy()
        after = np.tile(np.arange(1, n + 1), (rows, 1))
        before = np.tile(np.arange(-1, n - 1), (rows, 1))
        tree = np.full((rows, 2 * width), _NONE)
        rank = self.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, n - 1)
        tree[:, width : width + n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), _NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            i, r = root % width, root // width
            j = after[live, i]
            k = after[live, j]
            sym[live, i] = self.merged[r]
            sym[live, j] = -1
            after[live, i] = k
            inner = k < n
            before[live[inner], k[inner]] = i[inner]
            tree[live, width + j] = _NONE
            tree[live, width + i] = _NONE
            right = live[inner], i[inner], k[inner]
            h = before[live, i]
            has = h >= 0
            left = live[has], h[has], i[has]
            row, x, y = (np.concatenate(p) for p in zip(right, left, strict=True))
            rank = self.find(sym[row, x], sym[row, y])
            tree[row, width + x] = np.where(rank >= 0, rank * width + x, _NONE)
            up = np.concatenate([live, live, live[has]]), (np.concatenate([i, j, h[has]]) + width) >> 1
            while up[1][0]:
                tree[up] = np.minimum(tree[up[0], 2 * up[1]], tree[up[0], 2 * up[1] + 1])
                up = up[0], up[1] >> 1
            live = live[tree[live, 1] < _NONE]
        return sym

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """As ``merge`` for one row, all pairs of the lowest rank in one step."""
        n = len(symbols)
        width = 1 << (n - 1).bit_length()
        sym, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        tree = np.full(2 * width, _NONE)
        rank = self.find(sym[:-1], sym[1:])
        tree[width : width + n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), _NONE)
        level = width
        while level > 1:
            level //= 2
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
        while tree[1] < _NONE:
            r, nodes = tree[1] // width, np.ones(1, np.int64)
            while nodes[0] < width:
                nodes = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel()
                nodes = nodes[tree[nodes] // width == r]
            i = nodes - width
            # of pairs that share a symbol, the first, third, ... are merged
            at = np.arange(len(i))
            joined = np.zeros(len(i), bool)
            joined[1:] = after[i[:-1]] == i[1:]
            i = i[(at - np.maximum.accumulate(np.where(joined, 0, at))) % 2 == 0]
            j = after[i]
            k = after[j]
            sym[i], sym[j], after[i] = self.merged[r], -1, k
            before[k[k < n]] = i[k < n]
            tree[width + i] = tree[width + j] = _NONE
            x = np.unique(np.concatenate([i[k < n], before[i][before[i] >= 0]]))
            rank = self.find(sym[x], sym[after[x]])
            tree[width + x] = np.where(rank >= 0, rank * width + x, _NONE)
            up = np.unique(np.concatenate([i, j, x]) + width >> 1)
            while up[0]:
                tree[up] = np.minimum(tree[2 * up], tree[2 * up + 1])
                up = up >> 1
                up = up[np.concatenate([[True], up[1:] != up[:-1]])]
        return sym

    def words(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of each pre-token."""
        out: dict[str, bytes] = {}
        by: dict[int, list[tuple[str, bytes]]] = {}
        for t in tokens:
            b = t.encode()
            by.setdefault(len(b), []).append((t, b))
        for n, group in by.items():
            most = max(1, (1 << 19) // n)
            for at in range(0, len(group), most):
                some = group[at : at + most]
                raw = np.frombuffer(b"".join(b for _, b in some), np.uint8).reshape(len(some), n)
                sym = self.merge(self.byte_id[raw])
                kept = sym >= 0
                blob = sym[kept].astype("<u4").tobytes()
                ends = np.cumsum(kept.sum(1)) * 4
                begin = 0
                for (t, _), end in zip(some, ends.tolist(), strict=True):
                    out[t] = blob[begin:end]
                    begin = end
        return out


class Coder:
    """Encodes and decodes texts, remembering the ids of at most ``remember`` pre-tokens of at most 64 characters."""

    def __init__(self, path: str, remember: int = 400_000):
        self.vocabulary, self.known, self.remember = Vocabulary(path), {}, remember

    def pieces(self, text: str) -> list[tuple[str | None, list[str]]]:
        """(special token or None, pre-tokens) in order."""
        v = self.vocabulary
        if v.special_split is None or not any(s in text for s in v.special):
            return [(None, v.split.findall(text))]
        return [(p, []) if p in v.special else (None, v.split.findall(p)) for p in v.special_split.split(text) if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        wanted = {w for p in split for _, words in p for w in words}
        new = self.vocabulary.words([w for w in wanted if w not in self.known])
        if len(self.known) + len(new) > self.remember:
            new |= {w: self.known[w] for w in wanted if w in self.known}
            self.known = {}
        here = {**self.known, **new} if len(self.known) + len(new) > self.remember else None
        if here is None:
            self.known |= {w: b for w, b in new.items() if len(w) <= 64}
            long = {w: b for w, b in new.items() if len(w) > 64}
            get = self.known.__getitem__ if not long else lambda w: long.get(w) or self.known[w]
        else:
            get = here.__getitem__
        special = self.vocabulary.special
        return [b"".join(special[s].to_bytes(4, "little") if s else b"".join(map(get, words)) for s, words in p) for p in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder a worker process and vocabulary."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    for begin, end, _, _ in textops.slices(batch.column("text"), 1 << 21):
        yield begin, end, [t or "" for t in batch.column("text").slice(begin, end - begin).to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end, texts in _texts(b):
                blobs = coder(path).encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(begin, end - begin), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every array of ids; special tokens are written out, bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [coder(path).decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again and return doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids never leave the worker, so nothing larger than two digests a document is sent on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end, texts in _texts(b):
                c = coder(path)
                blobs = c.encode(texts)
                decoded = [c.decode(np.frombuffer(x, "<u4")) for x in blobs]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(begin, end - begin),
                        pa.array([len(x) // 4 for x in blobs], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in blobs]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
