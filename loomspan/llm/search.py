"""Ranked lexical search (operator 11): impact-ordered score-at-a-time.

A term is a maximal run of ASCII letters, digits and bytes from 0x80; only A-Z are lower-cased.  ``build_index`` cuts the
documents into shards of about ``shard_bytes`` of whole texts and writes one row for each shard and term: the documents
that hold it, grouped by exact impact, highest first.  The impact of a posting is integer, ``1000000000 tf div (1000 tf +
12 m)`` with ``m = 75 + 25 n N div L``, so it needs the number of documents N and of terms L, which a first pass counts;
documents are not moved.  A posting takes two bytes and every term of every document is indexed.

``search`` takes the items in blocks of at most ``block`` bytes of text, which are sent to the tasks.  For each block only the
rows of its terms are read and dealt by shard.  A task goes through its shards one after the other.  For an item it adds up
segments (postings of one term and impact) by falling contribution, weight times occurrences in the item times impact.  What a
document may still gain is at most the sum of the terms' next contributions; once no more than ``k`` documents can reach the
k-th score seen so far, in this shard or an earlier one of the task, adding up stops and the scores of these few are
completed.  A task sends on at most ``k`` documents an item.

Cases: a null or empty text, or one without a term, is no document of N and is never found; an item without terms finds
nothing; repeated documents are found each for itself and repeated items are answered each for itself; ties go to the
smaller id, null ids last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomspan.llm import textops
from loomspan.llm.common import cut, remove, shared_folder

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
#: Documents of a shard are numbered in two bytes.
_MOST = 1 << 16


class Index(NamedTuple):
    """``rows``: shard, term, df, postings, impacts, ends, ids; the row of term "" holds a shard's ids.  ``documents`` is N,
    ``terms`` L, ``path`` the folder of the table."""

    rows: DataFrame
    documents: int
    terms: int
    path: str


def terms(text: str | None) -> list[str]:
    """Terms of one text, in order."""
    buf, offsets = textops.buffers(pa.array([text], pa.string()))
    return textops.strings(textops.find_words(textops.LOWER[buf], offsets, _TERM)).to_pylist()


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms; exact also where the product leaves 64 bits."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return 75 + np.array([25 * int(x) * documents // total for x in n], np.int64)
    return 75 + 25 * n.astype(np.int64) * documents // max(total, 1)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _pieces(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most ``most`` bytes, or one longer row, and of at most 65,536 rows."""
    for row, end, buf, offsets in textops.slices(column, most):
        for a in range(row, end, _MOST):
            b = min(end, a + _MOST)
            cut_at = offsets[a - row : b - row + 1]
            yield a, buf[cut_at[0] : cut_at[-1]], cut_at - cut_at[0]


def _segments(buf: np.ndarray, offsets: np.ndarray, documents: int, total: int):
    """Terms of a shard in order of appearance, and for each its postings, distinct impacts and where these end."""
    words = textops.find_words(textops.LOWER[buf], offsets, _TERM)
    coded = textops.strings(words).dictionary_encode()
    n = np.diff(words.first)
    rows = len(n)
    key = np.sort(coded.indices.to_numpy().astype(np.int64) * rows + np.repeat(np.arange(rows), n))
    at = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(at, append=len(key))
    term, doc = np.divmod(key[at], rows)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * lengths(n, documents, total)[doc])
    order = np.argsort((term << 36) | ((1_000_000 - impact) << 16) | doc)
    term, doc, impact = term[order], doc[order].astype("<u2"), impact[order].astype("<i4")
    new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(impact, prepend=-1) != 0))
    first = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
    seg_first = np.searchsorted(new, first)
    ends = (np.append(new[1:], len(term)) - first[term[new]]).astype("<i4")
    return coded.dictionary, n > 0, first, seg_first, doc, impact[new], ends


def _binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    at = (offsets * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20, path: str | None = None) -> Index:
    """Index every row; ``path`` is where the table goes, by default a new folder in the shared one."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/index-{uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([[0], *(np.diff(textops.find_words(buf, offsets, _TERM).first) for _, buf, offsets in _pieces(b.column("text"), 1 << 20))])
            yield pa.RecordBatch.from_pydict({"docs": [int((n > 0).sum())], "terms": [int(n.sum())]})

    known = rows.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    documents, total = int(known[0] or 0), int(known[1] or 0)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            for row, buf, offsets in _pieces(b.column("text"), shard_bytes):
                names, some, first, seg_first, doc, impacts, ends = _segments(buf, offsets, documents, total)
                if not some.any():
                    continue
                ids = b.column("doc_id").slice(row, len(some))
                size = len(names)
                zero = np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size + 1, shard)),
                        pa.concat_arrays([pa.array([""], pa.large_string()), names]).cast(pa.string()),
                        pa.array(np.concatenate([zero, np.diff(first)])),
                        _binary(np.concatenate([zero, first]), doc).cast(pa.binary()),
                        _binary(np.concatenate([zero, seg_first]), impacts).cast(pa.binary()),
                        _binary(np.concatenate([zero, seg_first]), ends).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([zero, np.full(size + 1, len(ids))]).astype(np.int32)), ids),  # all in the first row
                    ],
                    names=["shard", "term", "df", "postings", "impacts", "ends", "ids"],
                )
                shard += 1

    schema = f"shard long, term string, df long, postings binary, impacts binary, ends binary, ids array<{dict(rows.dtypes)['doc_id']}>"
    rows.mapInArrow(build, schema).write.parquet(path)
    return Index(spark.read.parquet(path), documents, total, path)


class _Query(NamedTuple):
    number: int
    item: object
    terms: list[str]
    weights: np.ndarray


def _flat(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every segment, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def score_at_a_time(value: np.ndarray, term: np.ndarray, start: np.ndarray, length: np.ndarray, postings: np.ndarray, docs: int, k: int, least: int = 1, step: int = 1024) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (and exact scores) that may be among the best ``k`` and reach ``least``, and the postings that were added up.

    Segment i adds ``value[i]`` to the documents ``postings[start[i] : start[i] + length[i]]``; segments of one ``term`` stand
    together with falling values, and a document is in one of them at most.
    """
    order = np.argsort(-value, kind="stable")
    bound = np.cumsum(length[order])
    last = np.append(np.flatnonzero(np.diff(term)), len(term) - 1) if len(term) else np.zeros(0, np.int64)
    ahead = np.append(0, last[:-1] + 1) if len(last) else last  # next segment of each term
    slot = np.cumsum(np.diff(term, prepend=term[0]) != 0) if len(term) else term
    sums, done, kth = np.zeros(docs, np.int64), 0, least
    while done < len(order):
        end = min(len(order), int(np.searchsorted(bound, (bound[done - 1] if done else 0) + step)) + 1)
        part = order[done:end]
        np.add.at(sums, postings[_flat(start[part], length[part])], np.repeat(value[part], length[part]))
        ahead = ahead + np.bincount(slot[part], minlength=len(last))
        done, step = end, step * 2
        if docs >= k:
            kth = max(least, int(np.partition(sums, docs - k)[docs - k]))
        gain = int(value[ahead[ahead <= last]].sum())
        if done == len(order) or gain >= kth:
            continue
        open_ = np.flatnonzero(sums + gain >= kth)
        if len(open_) <= k:  # nobody else can reach the k-th score: complete these
            mark = np.zeros(docs, bool)
            mark[open_] = True
            rest = order[done:] if len(open_) else order[:0]
            doc, add = postings[_flat(start[rest], length[rest])], np.repeat(value[rest], length[rest])
            np.add.at(sums, doc[mark[doc]], add[mark[doc]])
            open_ = open_[sums[open_] >= least]
            return open_, sums[open_], int(bound[done - 1])
    found = np.flatnonzero(sums >= kth)
    return found, sums[found], int(bound[-1]) if len(bound) else 0


_BEST = [("score", "descending"), ("doc_id", "ascending")]


def _better(best: pa.Table | None, scores: np.ndarray, ids: pa.Array, k: int) -> pa.Table:
    now = pa.table({"score": pa.array(scores, pa.int64()), "doc_id": ids})
    now = pa.concat_tables([best, now]) if best is not None else now
    return now.take(pc.sort_indices(now, sort_keys=_BEST, null_placement="at_end")[:k])


def _search_shard(rows: pa.Table, queries: list[_Query], best: list[pa.Table | None], k: int) -> None:
    """Merge what one shard holds into the best documents of every query."""
    names = rows.column("term").to_pylist()
    postings, impacts, ends = ([np.frombuffer(x, t).astype(np.int64) for x in rows.column(c).to_pylist()] for c, t in (("postings", "<u2"), ("impacts", "<i4"), ("ends", "<i4")))
    base = np.cumsum([0, *map(len, postings)])
    every, row = np.concatenate(postings), {t: i for i, t in enumerate(names)}
    ids = rows.column("ids").combine_chunks()[row[""]].values
    length = [np.diff(e, prepend=0) for e in ends]
    for i, q in enumerate(queries):
        here = [(row[t], w) for t, w in zip(q.terms, q.weights) if w and t in row]
        if not here:
            continue
        at = [r for r, _ in here]
        value = np.concatenate([impacts[r] * w for r, w in here])
        term = np.repeat(np.arange(len(here)), [len(impacts[r]) for r in at])
        size = np.concatenate([length[r] for r in at])
        start = np.concatenate([base[r] + ends[r] - length[r] for r in at])
        full = best[i] is not None and best[i].num_rows == k
        found, scores, _ = score_at_a_time(value, term, start, size, every, len(ids), k, best[i]["score"][k - 1].as_py() if full else 1)
        if len(found):
            best[i] = _better(best[i], scores, ids.take(pa.array(found)), k)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one shard after the other, from batches sorted by shard."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        shard = b.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            if held and held[0].column("shard")[0].as_py() != shard[x]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[object, str]]]:
    rows = items.where(F.length("text") > 0)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // block))
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", block: int = 4 << 20) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank (from 1), doc_id, score."""
    spark = items.sparkSession
    items = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    id_type, item_type = index.rows.schema["ids"].dataType.elementType, items.schema["item_id"].dataType
    schema = f"query long, item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score long"
    out, number = spark.createDataFrame([], schema), 0
    for rows in _blocks(items, block):
        counted = [(item, Counter(terms(text))) for item, text in rows]
        vocabulary = sorted({t for _, c in counted for t in c})
        if not vocabulary:
            continue
        wanted = spark.createDataFrame([("",), *((t,) for t in vocabulary)], "term string")
        near = index.rows.join(F.broadcast(wanted), "term", "left_semi")
        df = {r["term"]: r["df"] for r in near.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        w = {t: weight(index.documents, n) for t, n in df.items() if t}
        queries = []
        for item, c in counted:
            held = [t for t in sorted(c) if t in w]
            queries.append(_Query(number, item, held, np.array([w[t] * c[t] for t in held], np.int64)))
            number += 1
        sent = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value
            best: list[pa.Table | None] = [None] * len(queries)
            for rows in _shards(batches):
                _search_shard(rows, queries, best, k)
            for q, b in zip(queries, best):
                if b is not None:
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([q.number] * n, pa.int64()), pa.array([q.item] * n, to_arrow_type(item_type)), b["doc_id"].combine_chunks(), b["score"].combine_chunks()],
                        names=["query", "item_id", "doc_id", "score"],
                    )

        dealt = near.drop("df").repartition("shard").sortWithinPartitions("shard")
        out = out.unionByName(dealt.mapInArrow(run, schema))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index ``docs``, answer ``items`` and remove the index."""
    index = build_index(docs)
    found = cut(search(index, items, k))
    remove(docs.sparkSession, index.path)
    return found
