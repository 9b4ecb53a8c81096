"""Benchmark decontamination (operator 9): template canonicalisation.

Every token is cut to its core (outer punctuation goes, ASCII letters become lower case) and typed: a number, a number
with a unit, a unit, or a name (capitalised inside a sentence) becomes a placeholder, other words stay.  Windows of
``size`` consecutive typed tokens are hash-joined between the benchmark and the documents.  Windows on one diagonal
(document position less item position) fill the item's slots with values of the document; the diagonal's mapping joins
each value of the item to the one it meets most, one to one.  A window is found if its slots are verbatim or if all
of them agree with that mapping.  Beside its template every window of an item is looked up by its exact token values,
which finds windows that are all placeholders and names that stand at the start of a sentence on one side.  A document
holds an item if at least ``share`` of the item's windows, or of those with a literal word, are found so; a question
whose numbers, names or units were exchanged still matches.  An item of fewer than ``size`` tokens is held where
its token values stand in a row.

The benchmark is a stated query set: it is taken in blocks of at most ``block`` bytes of text, each of them sent to
the tasks once, and every block meets all documents.

Cases: null or empty texts match nothing; an item of fewer than ``size`` tokens counts as one window; items without
a token are never reported; null ids stay null; repeated rows are reported as often as they occur; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomspan.llm import textops

#: Units that are recognised as words of their own or after a number.
UNITS = [
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "lb", "oz", "ml",
    "cl", "l", "gal", "s", "sec", "min", "h", "hr", "ms", "kb", "mb", "gb", "tb", "hz",
    "khz", "mhz", "ghz", "w", "kw", "v", "a", "j", "kj", "cal", "kcal", "n", "pa", "kpa",
    "metre", "metres", "meter", "meters", "kilometre", "kilometres", "kilometer", "kilometers", "gram", "grams", "kilogram", "kilograms", "litre", "litres",
    "liter", "liters", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
]
_DIGIT, _CORE, _ALPHA, _UPPER = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_CORE[:] = _DIGIT | _ALPHA
_UPPER[65:91] = True
WORD, NUMBER, UNIT, QUANTITY, NAME = range(5)
_PLACE = np.array([0, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _unit_hashes() -> np.ndarray:
    buf, offsets = textops.buffers(pa.array([" ".join(sorted(UNITS))]))
    return np.sort(textops.word_hashes(textops.find_words(buf, offsets)))


_UNIT_HASHES = _unit_hashes()


class Tokens(NamedTuple):
    """Typed tokens: key (word hash or placeholder), value (hash of the core), kind; text i has first[i]:first[i + 1]."""

    key: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    first: np.ndarray


def tokens(buf: np.ndarray, offsets: np.ndarray) -> Tokens:
    words = textops.find_words(buf, offsets)
    at = np.flatnonzero(_CORE[buf])
    lo, hi = np.searchsorted(at, words.starts), np.searchsorted(at, words.ends)
    some = np.flatnonzero(hi > lo)
    start, end = at[lo[some]], at[hi[some] - 1] + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))[some]
    first = np.searchsorted(text, np.arange(len(offsets)))
    low = textops.LOWER[buf]
    value = textops.hash_ranges(low, start, end)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    digits, letters = count(_DIGIT[buf]), count(_ALPHA[buf])
    has_digit, has_letter = digits[end] > digits[start], letters[end] > letters[start]
    kind = np.zeros(len(start), np.int8)
    kind[has_digit & ~has_letter] = NUMBER
    mixed = np.flatnonzero(has_digit & has_letter & _DIGIT[buf[start]])
    if len(mixed):
        # digits, then a unit
        seen = np.flatnonzero(_ALPHA[buf])
        tail = seen[np.searchsorted(seen, start[mixed])]
        only = digits[end[mixed]] == digits[tail]
        unit = np.isin(textops.hash_ranges(low, tail, end[mixed]), _UNIT_HASHES)
        kind[mixed[only & unit]] = QUANTITY
    unit = np.isin(value, _UNIT_HASHES)
    follows = np.zeros(len(start), bool)
    follows[1:] = (kind[:-1] == NUMBER) & (text[1:] == text[:-1])
    kind[unit & follows] = UNIT
    # a name: capitalised, and the token before it in the same text ends no sentence and no line
    upper = _UPPER[buf[start]] & ~has_digit
    stop = count((buf == 46) | (buf == 33) | (buf == 63) | (buf == 58) | (buf == 10) | (buf == 13))
    inside = np.zeros(len(start), bool)
    inside[1:] = (text[1:] == text[:-1]) & (stop[start[1:]] == stop[end[:-1]])
    kind[upper & inside] = NAME
    return Tokens(np.where(kind == WORD, value, _PLACE[kind]), value, kind, first)


#: Keeps hashes of exact values apart from those of templates.
_EXACT = np.uint64(0x2545F4914F6CDD1D)


def exact_windows(t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the token values, text and position of every window inside one text."""
    n = np.diff(t.first)
    text = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(text)) - np.repeat(t.first[:-1], n)
    at = np.flatnonzero(np.repeat(n, n) - pos >= size)
    return textops.window_hashes(t.value, size)[at] ^ _EXACT, text[at], pos[at]


def template_windows(t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and position of every window inside one text that has at least one literal word."""
    n = np.diff(t.first)
    text = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(text)) - np.repeat(t.first[:-1], n)
    hashes = textops.window_hashes(t.key, size)
    literal = np.concatenate([[0], np.cumsum(t.kind == WORD)])
    at = np.flatnonzero(np.repeat(n, n) - pos >= size)
    at = at[literal[at + size] > literal[at]]
    return hashes[at], text[at], pos[at]


class Items(NamedTuple):
    """A block of the benchmark: sorted window hashes with item and position, windows, windows with a literal word (by
    item, and which they are by token) and tokens of each item, and for each length under the window size the sorted
    hashes of the whole items of that length, with item."""

    ids: list
    hashes: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    count: np.ndarray
    literal_count: np.ndarray
    literal: np.ndarray
    tokens: Tokens
    filter: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


_FILTER_BITS = 22


def prepare(rows: list[tuple], size: int) -> Items:
    buf, offsets = textops.buffers(pa.array([t or "" for _, t in rows], pa.string()))
    t = tokens(buf, offsets)
    h, item, pos = template_windows(t, size)
    literal = np.zeros(len(t.key), bool)
    literal[t.first[item] + pos] = True
    literal_count = np.bincount(item, minlength=len(rows))
    exact, exact_item, exact_pos = exact_windows(t, size)
    count = np.bincount(exact_item, minlength=len(rows))
    h, item, pos = np.concatenate([h, exact]), np.concatenate([item, exact_item]), np.concatenate([pos, exact_pos])
    order = np.argsort(h, kind="stable")
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    short = {}
    for n in range(1, size):
        whole, of, _ = exact_windows(t, n)
        mine = np.flatnonzero(np.diff(t.first)[of] == n)
        by = mine[np.argsort(whole[mine], kind="stable")]
        if len(by):
            short[n] = whole[by], of[by]
    return Items([i for i, _ in rows], h[order], item[order], pos[order], count, literal_count, literal, t, seen, short)


def _most(keys: list, values: list, verbatim: list) -> dict:
    """For each key the value it meets most; of equally frequent ones the verbatim one, then the first."""
    seen = {}
    for k, v, same in zip(keys, values, verbatim, strict=True):
        per = seen.setdefault(k, {})
        n, _ = per.get(v, (0, same))
        per[v] = (n + 1, same)
    return {k: max(per, key=per.get) for k, per in seen.items()}


def _consistent(items: Items, doc: Tokens, item: int, base: int, pairs: np.ndarray, size: int) -> np.ndarray:
    """Of (document position, item position) windows, those whose slots are verbatim or agree with their diagonal's mapping."""
    keep = np.zeros(len(pairs), bool)
    diagonal = pairs[:, 0] - pairs[:, 1]
    origin = items.tokens.first[item]
    for d in np.unique(diagonal):
        on = np.flatnonzero(diagonal == d)
        at = np.unique((pairs[on, 1][:, None] + np.arange(size)).ravel())
        slots = at[items.tokens.kind[origin + at] != WORD]
        kinds, values, met = items.tokens.kind[origin + slots], items.tokens.value[origin + slots], doc.value[base + slots + d]
        verbatim = values == met
        if verbatim.all():
            keep[on] = True
            continue
        same = verbatim.tolist()
        asked = list(zip(kinds.tolist(), values.tolist(), strict=True))
        given = list(zip(kinds.tolist(), met.tolist(), strict=True))
        there, back = _most(asked, given, same), _most(given, asked, same)
        agrees = np.array([there[a] == g and back[g] == a for a, g in zip(asked, given, strict=True)])
        # slots up to each place of the diagonal that differ, and that disagree
        places = np.searchsorted(slots, pairs[on, 1]), np.searchsorted(slots, pairs[on, 1] + size)
        for fits in (verbatim, agrees):
            bad = np.concatenate([[0], np.cumsum(~fits)])
            keep[on] |= bad[places[1]] == bad[places[0]]
    return keep


def _held(items: Items, item: int, at: np.ndarray, share: float) -> tuple[int, int] | None:
    """Windows found and windows of the item, with a literal word or all, if one of the two has its share at ``at``."""
    at = np.unique(at)
    for found, total in ((int(items.literal[items.tokens.first[item] + at].sum()), int(items.literal_count[item])), (len(at), int(items.count[item]))):
        if found and found >= share * total:
            return found, total
    return None


def find(items: Items, column: pa.Array, size: int, share: float) -> Iterator[tuple[int, int, int, int, bool]]:
    """(row, item, windows found, windows of the item, slots changed) for every row that holds an item by its windows."""
    if not len(items.hashes):
        return
    for begin, _, buf, offsets in textops.slices(column):
        yield from ((begin + doc, *x) for doc, *x in _by_windows(items, tokens(buf, offsets), size, share))


def find_all(items: Items, column: pa.Array, size: int, share: float) -> Iterator[tuple[int, int, int, int, bool]]:
    """As ``find``, with the items of fewer tokens than a window has, each of them one window."""
    for begin, _, buf, offsets in textops.slices(column):
        t = tokens(buf, offsets)
        if len(items.hashes):
            yield from ((begin + doc, *x) for doc, *x in _by_windows(items, t, size, share))
        for n, (whole, item) in items.short.items():
            h, text, _ = exact_windows(t, n)
            lo, hi = np.searchsorted(whole, h), np.searchsorted(whole, h, "right")
            some = np.flatnonzero(hi > lo)
            for doc, a, b in np.unique(np.stack([text[some], lo[some], hi[some]], 1), axis=0).tolist():
                yield from ((begin + doc, i, 1, 1, False) for i in item[a:b].tolist())


def _hits(items: Items, t: Tokens, size: int, most: int) -> Iterator[np.ndarray]:
    """Rows (text, item, position, item position, exact) of windows that meet, by text and item.

    Many items may share a template.  Where over ``most`` rows would meet, items are taken in turns, and windows in runs, so that
    about ``most`` rows are held at a time."""
    found = []
    for exact, (h, text, pos) in enumerate((template_windows(t, size), exact_windows(t, size))):
        near = np.flatnonzero(items.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        lo, hi = (np.searchsorted(items.hashes, h[near], side) for side in ("left", "right"))
        some = np.flatnonzero(hi > lo)
        found.append((exact, text[near][some], pos[near][some], lo[some], (hi - lo)[some]))
    turns = max(1, -(-int(sum(n.sum() for *_, n in found)) // most))
    for turn in range(turns):
        parts = [np.zeros((0, 5), np.int64)]
        for exact, text, pos, lo, n in found:
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // most, prepend=0)) if turns > 1 else np.zeros(0, np.int64)
            for i in np.split(np.arange(len(n)), cuts):
                m = n[i]
                at = np.repeat(lo[i] - np.cumsum(m) + m, m) + np.arange(m.sum())
                rows = np.stack([np.repeat(text[i], m), items.item[at], np.repeat(pos[i], m), items.pos[at], np.full(len(at), exact)], 1)
                parts.append(rows[rows[:, 1] % turns == turn] if turns > 1 else rows)
        rows = np.concatenate(parts)
        yield rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def _by_windows(items: Items, t: Tokens, size: int, share: float, most: int = 1 << 22) -> Iterator[tuple[int, int, int, int, bool]]:
    for rows in _hits(items, t, size, most):
        yield from _judged(items, t, rows, size, share)


def _judged(items: Items, t: Tokens, rows: np.ndarray, size: int, share: float) -> Iterator[tuple[int, int, int, int, bool]]:
    cuts = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], 1)) + 1
    for group in np.split(rows, cuts) if len(rows) else ():
        doc, item = int(group[0, 0]), int(group[0, 1])
        if not _held(items, item, group[:, 3], share):
            continue
        sure = group[:, 4] == 1
        sure[~sure] = _consistent(items, t, item, int(t.first[doc]), group[~sure, 2:4], size)
        good = group[sure]
        held = _held(items, item, good[:, 3], share)
        if held:
            a = (good[:, 3][:, None] + np.arange(size)).ravel() + items.tokens.first[item]
            b = (good[:, 2][:, None] + np.arange(size)).ravel() + t.first[doc]
            yield doc, item, *held, bool((items.tokens.value[a] != t.value[b]).any())


def blocks(benchmark: DataFrame, size: int, item_col: str, text_col: str, block: int) -> Iterator[Items]:
    """The benchmark in parts of about ``block`` bytes of text; rows that say the same twice are taken once."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where(F.length("text") > 0).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // block))
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        yield prepare([(r["item_id"], r["text"]) for r in part.collect()], size)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, block: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, windows, item_windows, slots_changed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item = benchmark.schema[item_col].dataType
    item_type, arrow_type = item.simpleString(), to_arrow_type(item)
    out = None
    for items in blocks(benchmark, size, item_col, item_text_col, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for b in batches:
                hits = list(find_all(items, b.column("text"), size, share))
                ids = b.column("doc_id").take(pa.array([x[0] for x in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([items.ids[x[1]] for x in hits]).cast(arrow_type), pa.array([x[2] for x in hits], pa.int64()), pa.array([x[3] for x in hits], pa.int64()), pa.array([x[4] for x in hits], pa.bool_())],
                    names=["doc_id", "item_id", "windows", "item_windows", "slots_changed"],
                )

        part = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {item_type}, windows long, item_windows long, slots_changed boolean")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, block: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark; rows pass through, nothing is joined."""
    for items in blocks(benchmark, size, "item_id", "text", block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in find_all(sent.value, b.column(text_col), size, share)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
