"""Substring dedup (operator 1): difference-cover anchors.

A window of ``length`` words that occurs twice starts, in both places, at positions whose distance to some common
aligned position is below ``period``: the cover {3, 6, 7, 12, 14} holds, modulo 21, one pair for every difference.
So only positions in the cover are hashed, over ``length - 20`` words (an anchor), and any repeated window contains an
anchor at one offset in both places that repeats as well.  Anchors that repeat are then extended: windows around
them are hashed at full length (96 bits) and counted, and only those that start at two places or more are removed.

Texts that are equal are processed once and carry a count.  Both counts are hash exchanges of packed arrays: a map
task sends one row for each hash bucket with all its keys, and a bucket answers with the positions that repeat, so
rows are few.  A key that many texts hold reaches its bucket once
from each task, whatever its count.

Cases: a null text has no words; ids may be null or repeat (each row is a text of its own and so starts windows of
its own); texts shorter than a window lose nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textops
from loomspan.llm.common import text_bytes, width

PERIOD = 21
#: A perfect difference cover modulo 21 (fixed values).
COVER = (3, 6, 7, 12, 14)
_PACK = 1 << 20


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7919), body).alias("k2")]


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """k1, k2, text, copies: equal texts folded in each task before the one shuffle of texts."""
    return docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


_PACKED = "bucket int, known boolean, high binary, low binary, pos binary, k1 binary, k2 binary, run binary"


def _same(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and for each place in it whether the key is that of the place before."""
    order = np.lexsort((low, high)) if len(low) else np.argsort(high, kind="stable")
    again = np.zeros(len(high), bool)
    again[1:] = high[order][1:] == high[order][:-1]
    if len(low):
        again[1:] &= low[order][1:] == low[order][:-1]
    return order, again


def _repeats(order: np.ndarray, again: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), bool)
    out[order[again]] = True
    out[order[:-1][again[1:]]] = True
    return out


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], 0)]))


class _Packer:
    """Gathers (key, text, position) of many texts and emits one row a bucket.

    A key that occurs again in the same task is known to repeat: only its first place is sent with the key, so however
    common a key is, its bucket gets one entry from each task; the places already known go to a bucket of their text.
    """

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, high: np.ndarray, low: np.ndarray, pos: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> None:
        if len(high):
            self.parts.append((high, low, pos, k1, k2))
            self.held += len(high)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        high, low, pos, k1, k2 = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order, again = _same(high, low)
        known = _repeats(order, again)
        witness = np.ones(len(high), bool)
        witness[order[again]] = False
        del order, again
        out: dict[str, list] = {c: [] for c in ("bucket", "known", "high", "low", "pos", "k1", "k2", "run")}
        for told, chosen, by in ((False, witness, high), (True, known, k1.view(np.uint64))):
            at = np.flatnonzero(chosen)
            bucket = (by[at] % np.uint64(self.buckets)).astype(np.int32)
            turn = np.argsort(bucket, kind="stable")
            bucket, at = bucket[turn], at[turn]
            cuts = np.append(_new(bucket), len(bucket))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                i = at[a:b]
                new = _new(k1[i], k2[i])
                out["bucket"].append(int(bucket[a]))
                out["known"].append(told)
                out["high"].append(b"" if told else high[i].tobytes())
                out["low"].append(b"" if told or not len(low) else low[i].tobytes())
                out["pos"].append(pos[i].tobytes())
                out["k1"].append(k1[i][new].tobytes())
                out["k2"].append(k2[i][new].tobytes())
                out["run"].append(np.diff(np.append(new, b - a)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["known"]), *(pa.array(out[c], pa.binary()) for c in list(out)[2:])], names=list(out))


def _repeated(packed: pa.Table, dests: int) -> pa.Table:
    """Of one bucket: per text, the positions whose key occurs at two positions or more, and those already known."""
    known = packed.filter(packed.column("known"))
    fresh = packed.filter(pa.compute.invert(packed.column("known")))

    def read(t: pa.Table, c: str, kind: type) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in t.column(c).to_pylist())])

    def places(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        run = read(t, "run", np.uint32)
        return np.repeat(read(t, "k1", np.int64), run), np.repeat(read(t, "k2", np.int64), run), read(t, "pos", np.uint32).astype(np.int32)

    again = np.flatnonzero(_repeats(*_same(read(fresh, "high", np.uint64), read(fresh, "low", np.uint32))))
    k1, k2, pos = (np.concatenate([x, y[again]]) for x, y in zip(places(known), places(fresh), strict=True))
    dest = (k1.view(np.uint64) % np.uint64(dests)).astype(np.int32)
    turn = np.argsort(dest, kind="stable")
    dest, k1, k2, pos = dest[turn], k1[turn], k2[turn], pos[turn]
    cuts = np.append(_new(dest), len(dest)).tolist()
    part = list(zip(cuts[:-1], cuts[1:], strict=True))
    blobs = [pa.array([c[x:y].tobytes() for x, y in part], pa.binary()) for c in (k1, k2, pos)]
    return pa.table([pa.array(dest[cuts[:-1]]), *blobs], names=["dest", "k1", "k2", "pos"])


def _gathered(answers: pa.Table) -> pa.Table:
    """One row a text: all its positions."""
    k1, k2, pos = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in answers.column(c).to_pylist())]) for c, t in (("k1", np.int64), ("k2", np.int64), ("pos", np.int32)))
    order = np.lexsort((pos, k2, k1))
    k1, k2, pos = k1[order], k2[order], pos[order]
    new = _new(k1, k2)
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(pos)).astype(np.int32)), pa.array(pos))
    return pa.table([pa.array(k1[new]), pa.array(k2[new]), lists], names=["k1", "k2", "pos"])


def _positions(packed: DataFrame, dests: int) -> DataFrame:
    """k1, k2, pos: what the buckets answer, packed by destination so that a text's answers meet in one row."""
    answers = packed.groupBy("bucket").applyInArrow(lambda t: _repeated(t, dests), "dest int, k1 binary, k2 binary, pos binary")
    return answers.groupBy("dest").applyInArrow(_gathered, "k1 long, k2 long, pos array<int>")


def _packing(buckets: int, keys: Callable) -> Callable:
    """A mapInArrow function that packs what ``keys`` finds in each run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for begin, end, buf, offsets in textops.slices(b.column("text")):
                words = textops.find_words(buf, offsets)
                high, low, pos, text = keys(b.slice(begin, end - begin), words)
                packer.add(high, low, pos.astype(np.uint32), k1[begin:end][text], k2[begin:end][text])
                if packer.held >= _PACK:
                    yield from packer.rows()
        yield from packer.rows()

    return run


def _place(words: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position in it and words left from it on, of every word."""
    n = np.diff(words.first)
    text = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(text)) - np.repeat(words.first[:-1], n)
    return text, pos, np.repeat(n, n) - pos


def _anchors(length: int) -> Callable:
    k = length - PERIOD + 1
    covered = np.isin(np.arange(PERIOD), COVER)

    def keys(batch: pa.RecordBatch, words: textops.Words) -> tuple:
        text, pos, left = _place(words)
        at = np.flatnonzero(covered[pos % PERIOD] & (left >= k))
        high = textops.window_hashes(textops.word_hashes(words), k)[at]
        return high, np.zeros(0, np.uint32), pos[at], text[at]

    return keys


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of a list column."""
    filled = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    sizes = np.diff(filled.offsets.to_numpy())
    return np.repeat(np.arange(len(filled)), sizes), filled.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(length: int) -> Callable:
    def keys(batch: pa.RecordBatch, words: textops.Words) -> tuple:
        text, pos, left = _place(words)
        row, anchor = _lists(batch.column("pos"))
        mark = np.zeros(len(text) + PERIOD + 1, np.int32)
        np.add.at(mark, words.first[row] + np.maximum(anchor - PERIOD + 1, 0), 1)
        np.add.at(mark, words.first[row] + anchor + 1, -1)
        at = np.flatnonzero((np.cumsum(mark)[: len(text)] > 0) & (left >= length))
        high = textops.window_hashes(textops.word_hashes(words), length)[at]
        low = textops.window_hashes(textops.word_hashes(words, 23), length, 23)[at]
        return high, low.astype(np.uint32), pos[at], text[at]

    return keys


def _cut_out(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end, buf, offsets in textops.slices(b.column("text")):
                part = b.slice(begin, end - begin)
                words = textops.find_words(buf, offsets)
                n = np.diff(words.first)
                row, at = _lists(part.column("pos"))
                whole = np.flatnonzero((part.column("copies").to_numpy() > 1) & (n >= length))
                mark = np.zeros(words.first[-1] + 1, np.int32)
                np.add.at(mark, words.first[row] + at, 1)
                np.add.at(mark, words.first[row] + at + length, -1)
                mark[words.first[whole]] += 1
                mark[words.first[whole + 1]] -= 1
                kept = np.cumsum(mark)[:-1] <= 0
                flat, bounds = textops.joined(words, kept)
                left = np.concatenate([[0], np.cumsum(kept)])[words.first]
                raw = flat.tobytes()
                edges = bounds.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k1"),
                        part.column("k2"),
                        pa.array(n.astype(np.int64)),
                        pa.array((n - np.diff(left)).astype(np.int64)),
                        pa.array([raw[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    ],
                    names=["k1", "k2", "n_words", "n_removed", "kept"],
                )

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in b.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], sha], names=["k1", "k2", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and ``kept`` (the words left, joined by one space).

    A bucket is a group held whole by one task; there is one for each ``bucket_bytes`` of text (at least one for each
    partition of a shuffle), so that groups stay as small when the texts grow.

    With ``digest`` the column is ``kept_sha256`` instead and the texts themselves are not sent on.
    """
    if length <= PERIOD:
        raise ValueError(f"windows have more than {PERIOD} words")
    buckets = max(width(docs.sparkSession), -(-text_bytes(docs, text_col) // bucket_bytes))
    texts = distinct_texts(docs, text_col)
    anchors = _positions(texts.mapInArrow(_packing(buckets, _anchors(length)), _PACKED), buckets)
    near = texts.join(anchors, ["k1", "k2"])
    windows = _positions(near.mapInArrow(_packing(buckets, _windows(length)), _PACKED), buckets)
    cut, kind = _cut_out(length), "k1 long, k2 long, n_words long, n_removed long"
    last = (lambda batches: _digest(cut(batches))) if digest else cut
    done = texts.join(windows, ["k1", "k2"], "left").mapInArrow(last, f"{kind}, {'kept_sha256 string' if digest else 'kept binary'}")
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)))
    kept = F.col("kept_sha256") if digest else F.col("kept").cast("string").alias("kept")
    return rows.join(done, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", kept)
