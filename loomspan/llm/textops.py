"""Vectorised word handling over Arrow string columns, shared by the operators of this subpackage.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``.  Those separators are single ASCII bytes, so
working on UTF-8 bytes gives the same words as working on code points.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD_BYTE = ~SEPARATORS
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BLOCK = 1 << 18
U64 = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Base(NamedTuple):
    byte: np.ndarray
    up: np.ndarray
    down: np.ndarray
    step: int
    back: int


_MASK = (1 << 64) - 1


def _base(seed: int) -> _Base:
    rng = np.random.default_rng(seed)
    byte = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    mul = int(rng.integers(1, 1 << 62)) * 4 * 2 + 3
    mul &= _MASK
    inv = pow(mul, -1, 1 << 64)
    return _Base(byte, _powers(mul, _BLOCK), _powers(inv, _BLOCK), pow(mul, _BLOCK, 1 << 64), pow(inv, _BLOCK, 1 << 64))


_BASES = {s: _base(s) for s in (11, 23)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U64(32))


class Words(NamedTuple):
    """Words of consecutive texts: byte ranges in ``buf``; text i has words ``first[i]`` to ``first[i + 1]``."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(large)
    if column.null_count:
        column = column.fill_null(b"" if large == pa.large_binary() else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off is not None and len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``most`` bytes, or one longer row."""
    buf, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, buf[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def find_words(buf: np.ndarray, offsets: np.ndarray, of: np.ndarray = _WORD_BYTE) -> Words:
    """Maximal runs of the bytes marked in ``of`` (by default, of all but separators) within each text."""
    word = of[buf]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begin)
    return Words(buf, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def strings(words: Words) -> pa.LargeStringArray:
    """The words themselves, one after the other."""
    inside = np.zeros(len(words.buf) + 1, np.int8)
    inside[words.starts] = 1
    inside[words.ends] -= 1
    flat = words.buf[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(offsets), pa.py_buffer(flat))


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
    """64-bit hash of each byte range; ranges must be ascending and may not overlap."""
    base = _BASES[seed]
    at_start, at_end = np.zeros(len(starts), U64), np.zeros(len(ends), U64)
    carry, step, back = 0, 1, 1
    shift = np.ones(len(starts), U64)
    for b in range(0, max(len(buf), 1), _BLOCK):
        piece = buf[b : b + _BLOCK]
        run = np.zeros(len(piece) + 1, U64)
        np.cumsum(base.byte[piece] * base.up[: len(piece)], out=run[1:])
        run = run * U64(step) + U64(carry)
        s = slice(*np.searchsorted(starts, (b, b + len(piece))))
        at_start[s] = run[starts[s] - b]
        shift[s] = base.down[starts[s] - b] * U64(back)
        e = slice(*np.searchsorted(ends, (b + 1, b + len(piece) + 1)))
        at_end[e] = run[ends[e] - b]
        carry, step, back = int(run[-1]), step * base.step & _MASK, back * base.back & _MASK
    return mix((at_end - at_start) * shift + (ends - starts).astype(U64))


def word_hashes(words: Words, seed: int = 11) -> np.ndarray:
    return hash_ranges(words.buf, words.starts, words.ends, seed)


def window_hashes(hashes: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (runs across texts included; the caller drops those)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    base = _BASES[seed]
    mul = int(base.up[1]) ^ 0x5DEECE66C
    inv = pow(mul, -1, 1 << 64)
    out, block = np.empty(n - k + 1, U64), 1 << 16
    up, down = _powers(mul, block + k), _powers(inv, block + k)
    for b in range(0, n - k + 1, block):
        m = min(block, n - k + 1 - b)
        run = np.zeros(m + k, U64)
        np.cumsum(hashes[b : b + m + k - 1] * up[: m + k - 1], out=run[1:])
        out[b : b + m] = (run[k : k + m] - run[:m]) * down[:m]
    return mix(out)


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of every text joined by one space: bytes and offsets."""
    starts, ends = words.starts, words.ends
    text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.first))
    if keep is not None:
        starts, ends, text = starts[keep], ends[keep], text[keep]
    if keep is None:
        inside = _WORD_BYTE[words.buf]
    else:
        edge = np.zeros(len(words.buf) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    last = np.ones(len(starts), bool)
    last[:-1] = text[1:] != text[:-1]
    gaps = ends[~last]
    buf = words.buf.copy()
    inside[gaps] = True
    buf[gaps] = 0x20
    out = buf[inside]
    sizes = np.bincount(text, (ends - starts) + ~last, len(words.offsets) - 1).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def text_of(buf: np.ndarray, offsets: np.ndarray, i: int) -> bytes:
    return buf[offsets[i] : offsets[i + 1]].tobytes()
