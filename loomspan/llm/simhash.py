"""SimHash near-dedup (operator 6): pigeonring filtering.

A fingerprint has 64 bits; bit b is set if it is set in over half the XXH64 values of the document's word shingles.
Two fingerprints link if they differ in at most ``within`` bits.  The 64 bits lie on a ring of five segments.  By the
pigeonring principle a linked pair has a start segment from which every chain of n consecutive segments differs in at
most ``floor(n * within / 5)`` bits.  Chains of two segments generate the candidates: from each start a fingerprint is
filed under the exact value of both segments, and asks under every value within the budgets (first segment equal, at
most one bit of the second).  A candidate's chain is then extended round the ring from its start, and a pair that
breaks a budget on the way is dropped; what comes round whole differs in at most ``within`` bits.

Work is done on distinct fingerprints.  A value's fingerprints are linked by a breadth-first walk that returns a
spanning forest, never all pairs.  A value with over ``crowd`` fingerprints is not walked where it is found: its
fingerprints are dealt over all tasks again by runs of the bits outside the chain, half of which a linked pair shares.
Links become components by star steps on Spark, whose nodes are the least row of each fingerprint.

Cases: a null or empty text has fingerprint zero and links as any other; repeated rows share a fingerprint; a null id
is never a component id unless its component has no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textops
from loomspan.llm.common import cut, text_digest, width
from loomspan.llm.components import components

SEGMENTS = 5
#: (first bit, bits) of each segment.
_AT = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Runs of the bits outside a chain of two segments by which a crowded value is dealt again.
_RUNS = 8
_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_batch(column: pa.Array, words_per_shingle: int = 4) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    k, seed, digest = words_per_shingle, 42, xxhash.xxh64_intdigest
    out = np.zeros(len(column), np.uint64)
    for begin, end, buf, offsets in textops.slices(column, 1 << 20):
        flat, bounds = textops.joined(textops.find_words(textops.LOWER[buf], offsets))
        w = textops.find_words(flat, bounds)
        n = np.diff(w.first)
        many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.concatenate([[0], np.cumsum(many)])
        head = np.repeat(w.first[:-1] - first[:-1], many) + np.arange(first[-1])
        tail = head + np.repeat(np.minimum(n, k), many) - 1
        raw = flat.tobytes()
        spans = zip(w.starts[head].tolist(), w.ends[tail].tolist(), strict=True)
        h = np.fromiter((digest(raw[s:e], seed) for s, e in spans), np.uint64, int(first[-1]))
        full = np.flatnonzero(many)
        if not len(full):
            continue
        got = np.zeros((len(full), 64), np.int64)
        step = 1 << 17
        for b in range(0, len(h), step):
            bits = np.unpackbits(h[b : b + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lo, hi = np.searchsorted(first[full], b, "right") - 1, np.searchsorted(first[full], b + len(bits))
            got[lo:hi] += np.add.reduceat(bits, np.maximum(first[full[lo:hi]] - b, 0), axis=0, dtype=np.int32)
        major = (2 * got > many[full, None]).astype(np.uint8)
        out[begin + full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", *, more: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row, and a binary column ``more``."""
    others = [more] if more else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprint_batch(b.column("text"), words_per_shingle).view(np.int64)), *map(b.column, others)], names=["doc_id", "fp", *others])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *others)
    return rows.mapInArrow(run, ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", "fp long", *(f"{c} binary" for c in others)]))


def budgets(within: int) -> list[int]:
    """Bits in which the first 1, 2, ... segments of a chain may differ."""
    return [n * within // SEGMENTS for n in range(1, SEGMENTS + 1)]


def turned(fps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fingerprints rotated so that segment ``start`` begins at bit 0."""
    by = np.array([at for at, _ in _AT], np.uint64)[start]
    return (fps >> by) | np.where(by > 0, fps << ((np.uint64(64) - by) % np.uint64(64)), np.uint64(0))


def chains(start: int) -> list[int]:
    """Masks, on a turned fingerprint, of the first 1, 2, ... segments of the ring from ``start``."""
    bits, out = 0, []
    for i in range(SEGMENTS):
        bits += _AT[(start + i) % SEGMENTS][1]
        out.append((1 << bits) - 1)
    return out


_CHAINS = np.array([chains(s) for s in range(SEGMENTS)], np.uint64)


def ring(diff: np.ndarray, start: np.ndarray, within: int) -> np.ndarray:
    """Which turned differences keep the budget of every chain from their start: those whose fingerprints are linked and
    found from there.  Each longer chain is looked at for the pairs the shorter ones have left."""
    left = np.arange(len(diff))
    for n, most in enumerate(budgets(within)):
        left = left[np.bitwise_count(diff[left] & _CHAINS[start[left], n]) <= most]
    out = np.zeros(len(diff), bool)
    out[left] = True
    return out


def probes(within: int) -> list[tuple[int, int, int]]:
    """(start, mask of the chain of two segments, change) of each value a fingerprint is filed under or asks for."""
    out = []
    for s in range(SEGMENTS):
        first, both = chains(s)[:2]
        changes = [0] + [1 << b for b in range(64) if (both & ~first) >> b & 1 and budgets(within)[1] >= 1]
        out += [(s, both, c) for c in changes]
    return out


Edges = list[tuple[int, int]]


def _walk(fps: np.ndarray, filed: np.ndarray, start: int, within: int) -> Edges:
    """Spanning forest of the links between a filed fingerprint and another, filed or asking, of one value."""
    edges: Edges = []
    order = np.argsort(~filed, kind="stable")
    rest, rest_filed = fps[order], filed[order]
    spin = np.array([start])
    while len(rest) and rest_filed[0]:
        front, front_filed, rest, rest_filed = rest[:1], rest_filed[:1], rest[1:], rest_filed[1:]
        while len(front) and len(rest):
            reached = np.full(len(rest), -1)
            for at in range(0, len(front), block := max(1, (1 << 18) // len(rest))):
                some, known = front[at : at + block], front_filed[at : at + block]
                i, j = np.nonzero(known[:, None] | rest_filed[None, :])
                hit = ring(turned(some[i] ^ rest[j], spin.repeat(len(i))), spin.repeat(len(i)), within)
                reached[j[hit]] = at + i[hit]
            got = reached >= 0
            edges += zip(front[reached[got]].tolist(), rest[got].tolist(), strict=True)
            front, front_filed, rest, rest_filed = rest[got], rest_filed[got], rest[~got], rest_filed[~got]
    return edges


def _settle(value: np.ndarray, run: np.ndarray, fp: np.ndarray, within: int) -> Edges:
    """Links of runs of rows with one value: small runs pair by pair side by side, larger ones by a walk."""
    start = (value >> np.uint64(60)).astype(np.int64)
    filed = (turned(fp, start) & _CHAINS[start, 1]) == (value & ((np.uint64(1) << np.uint64(32)) - np.uint64(1)))
    cuts = np.flatnonzero(run[1:] != run[:-1]) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(run)]])
    size = end - begin
    edges: Edges = []
    few = np.repeat(size <= 8, size)
    for shift in range(1, 8):
        if len(run) > shift:
            i = np.flatnonzero(few[:-shift] & (run[shift:] == run[:-shift]) & (filed[shift:] | filed[:-shift]))
            hit = i[ring(turned(fp[i] ^ fp[i + shift], start[i]), start[i], within)]
            edges += zip(fp[hit].tolist(), fp[hit + shift].tolist(), strict=True)
    for r in np.flatnonzero(size > 8):
        some = slice(begin[r], end[r])
        edges += _walk(fp[some], filed[some], int(start[begin[r]]), within)
    return edges


def _found(edges: Edges) -> pa.RecordBatch:
    pair = np.array(edges, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.nulls(len(pair), pa.int64())], names=["u", "v", "again"])


def _link_runs(within: int, crowd: int, by: tuple[str, ...]):
    """mapInArrow over rows sorted by the columns ``by`` (the last of them is the value): links u, v of each run.  A run
    of over ``crowd`` fingerprints comes back as rows u (the fingerprint) and again (the value) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        crowded = None

        def again(t: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t[-1]), pa.nulls(len(t[-1]), pa.int64()), pa.array(t[-2])], names=["u", "v", "again"])

        def settle(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            *keys, fp = (np.concatenate(c) for c in zip(*parts, strict=True))
            same = np.ones(max(len(fp) - 1, 0), bool)
            for k in keys:
                same &= k[1:] == k[:-1]
            cuts = np.flatnonzero(~same) + 1
            size = np.diff(np.concatenate([[0], cuts, [len(fp)]]))
            large = np.repeat(size > crowd, size)
            if large.any():
                yield again(tuple(c[large] for c in (*keys, fp)))
            if not large.all():
                number = np.repeat(np.arange(len(size)), size)[~large]
                edges = _settle(keys[-1][~large].view(np.uint64), number, fp[~large].view(np.uint64), within)
                if edges:
                    yield _found(edges)

        for b in batches:
            now = tuple(b.column(c).to_numpy() for c in (*by, "fp"))
            n = len(now[-1])
            if not n:
                continue
            if crowded is not None:
                on = np.all([k == v for k, v in zip(now[:-1], crowded, strict=True)], 0)
                stop = n if on.all() else int(np.argmin(on))
                if stop:
                    yield again(tuple(c[:stop] for c in now))
                now = tuple(c[stop:] for c in now)
                if not len(now[-1]):
                    continue
                crowded = None
            end = np.all([k == k[-1] for k in now[:-1]], 0)
            last = 0 if end.all() else len(end) - int(np.argmin(end[::-1]))
            if not last and kept and all(k[0] == p[-1] for k, p in zip(now[:-1], kept[-1][:-1], strict=True)):
                kept.append(now)
            else:
                done = [*kept, tuple(c[:last] for c in now)]
                if sum(len(d[-1]) for d in done):
                    yield from settle(done)
                kept = [tuple(c[last:] for c in now)]
            if sum(len(k[-1]) for k in kept) > crowd:
                crowded = tuple(k[-1] for k in kept[0][:-1])
                for k in kept:
                    yield again(k)
                kept = []
        if kept:
            yield from settle(kept)

    return run


def links(distinct: DataFrame, within: int = 4, crowd: int = 4096) -> DataFrame:
    """Edges u, v (signed fingerprints) whose components are those of all links among the distinct ``fp``."""
    if not 0 <= within <= 4:
        raise ValueError("five segments find links of at most four differing bits")
    n = width(distinct.sparkSession)
    table = F.array(*(F.struct(F.lit(_AT[s][0]).alias("turn"), F.lit(mask).cast("long").alias("mask"), F.lit(change).cast("long").alias("change"), F.lit(_signed(s << 60)).cast("long").alias("start")) for s, mask, change in probes(within)))
    value = F.expr("(((shiftrightunsigned(fp, p.turn) | if(p.turn = 0, 0L, shiftleft(fp, 64 - p.turn))) & p.mask) ^ p.change) | p.start").alias("value")
    found = cut(
        distinct.select("fp", F.explode(table).alias("p")).select("fp", value)
        .repartition(n, "value").sortWithinPartitions("value")
        .mapInArrow(_link_runs(within, crowd, ("value",)), "u long, v long, again long")
    )
    # crowded values: half of the runs of bits outside the chain agree in a linked pair
    deal = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(_signed(sum(1 << b for b in range(26, 64) if (b - 26) * _RUNS // 38 in c))).cast("long").alias("mask")) for k, c in enumerate(combinations(range(_RUNS), _RUNS - 4))))
    turn = F.element_at(F.array(*(F.lit(at) for at, _ in _AT)), (F.shiftrightunsigned("again", 60) + 1).cast("int"))
    dealt = (
        found.where("v IS NULL").select(F.col("u").alias("fp"), F.col("again").alias("value"), turn.alias("turn")).select("*", F.explode(deal).alias("d"))
        .select("fp", "value", F.xxhash64("d.k", F.expr("(shiftrightunsigned(fp, turn) | if(turn = 0, 0L, shiftleft(fp, 64 - turn))) & d.mask")).alias("part"))
        .repartition(n, "part", "value").sortWithinPartitions("part", "value")
        .mapInArrow(_link_runs(within, 1 << 62, ("part", "value")), "u long, v long, again long")
    )
    return found.where("v IS NOT NULL").select("u", "v").unionByName(dealt.select("u", "v")).distinct()


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _firsts(nodes: DataFrame, within: int) -> DataFrame:
    """For every distinct fingerprint with its own least ``rank`` (none, doc_id, tie): fp, rank, doc_id of the least rank of
    its component as ``first``, and whether that rank is its own as ``mine``.

    Components are taken over ids where no two fingerprints have the same least id and none lacks one, else over ranks.
    """
    plain = nodes.groupBy("rank.doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty()
    own = F.col("rank.doc_id") if plain else F.col("rank")
    ends = [nodes.select(F.col("fp").alias(c), own.alias(f"{c}_node")) for c in "uv"]
    edges = links(nodes.select("fp"), within).join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    known = components(edges)
    label = F.coalesce("label", own)
    return nodes.withColumn("node", own).join(known, "node", "left").select("fp", "rank", (label if plain else label["doc_id"]).alias("first"), label.eqNullSafe(own).alias("mine"))


def near_groups(docs: DataFrame, words_per_shingle: int = 4, within: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id (smallest id reachable over links, itself included)."""
    rows = cut(fingerprints(docs, words_per_shingle, id_col, text_col))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = _firsts(cut(least.select("fp", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), F.col("fp").alias("tie")).alias("rank"))), within)
    return rows.join(known, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id"))


def near_rows(docs: DataFrame, words_per_shingle: int = 4, within: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id and text: doc_id, digest (of the text), rows (that repeat both), kept.

    One of a component is kept: that with the smallest id, null ids last, then with the smallest digest.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_digest(F.col(text_col)).alias("digest"))
    rows = cut(fingerprints(named, words_per_shingle, more="digest").groupBy("doc_id", "digest", "fp").agg(F.count(F.lit(1)).alias("rows")))
    rank = lambda: F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("digest").alias("tie"))
    known = _firsts(cut(rows.groupBy("fp").agg(F.min(rank()).alias("rank"))), within)
    return rows.join(known, "fp").select("doc_id", "digest", "rows", (F.col("mine") & rank().eqNullSafe(F.col("rank"))).alias("kept"))
