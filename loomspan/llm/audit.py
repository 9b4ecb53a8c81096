"""Filter interaction audit (operator 12): lattice-edge aggregation.

What an order of filters keeps, removes and finds redundant depends, for every one of its steps, only on the set of filters
applied before and on the filter applied next.  Five filters have 80 such edges, so documents are counted on edges and the
600 steps of the 120 orders look their edge up.

A document is reduced to its part, the set of filters it fails and its labels; these are counted before anything is
expanded, so at most parts x 32 x 4 rows are spread over the 80 edges.  Filters A to D read the text in Arrow batches; E,
a copy of a document with a smaller id, is decided by digest: the smallest id of every repeated text is joined to the narrow
rows, and a text with many copies is a hot key of a join whose other side has one row for it.

Cases: a null text is the empty one, a null lang the part ""; a null id is never smaller than another and never fails E;
rows that repeat id and text are no copies of each other; a document counts as good or toxic if any of its labels says so, null
labels say nothing; an empty table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textops
from loomspan.llm.common import cut, text_digest

FILTERS = "ABCDE"
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*|"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Bytes that begin a code point.
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False


def _count(of: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of every text are marked in ``of``."""
    run = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(of[buf], out=run[1:])
    return np.diff(run[offsets])


def _distinct(words: textops.Words) -> np.ndarray:
    rows = len(words.first) - 1
    if not len(words.starts):
        return np.zeros(rows, np.int64)
    coded = textops.strings(words).dictionary_encode()
    key = np.sort(np.repeat(np.arange(rows), np.diff(words.first)) * len(coded.dictionary) + coded.indices.to_numpy())
    return np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] // len(coded.dictionary), minlength=rows)


def text_failures(column: pa.Array, least_words: int = 200) -> np.ndarray:
    """Which of A to D every text fails, as bits 1, 2, 4 and 8."""
    out = [np.zeros(0, np.int32)]
    for _, _, buf, offsets in textops.slices(column):
        words = textops.find_words(buf, offsets)
        n = np.diff(words.first)
        a = n < least_words
        b = 100 * _distinct(words) < 50 * n
        c = 100 * _count(_UPPER, buf, offsets) > 3 * _count(_POINT, buf, offsets)
        d = _count(_MARKS, buf, offsets) > 0
        out.append((a + 2 * b + 4 * c + 8 * d).astype(np.int32))
    return np.concatenate(out)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 200) -> DataFrame:
    """One row per document: doc_id, part, fails (bits of the filters A to E that it fails)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text_failures(b.column("text"), least_words))], names=["doc_id", "part", "digest", "bits"])

    judged = cut(rows.mapInArrow(judge, f"doc_id {id_type}, part string, digest binary, bits int"))  # texts are read once
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return judged.join(first, "digest", "left").select("doc_id", "part", (F.col("bits") + 16 * copy).alias("fails"))


def edge_counts(profile: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts on the edges of the lattice: part, before (bits of the filters applied), next (position of the filter), kept, removed,
    redundant, unique_fails, good_lost, toxic_lost.

    ``profile`` has part, fails, good, toxic and rows, the documents that share these.
    """
    size = len(filters)
    edges = [(before, i, 1 << i, math.factorial(before.bit_count()) * math.factorial(size - 1 - before.bit_count())) for before in range(1 << size) for i in range(size) if not before >> i & 1]
    lattice = profile.sparkSession.createDataFrame([(e, *x) for e, x in enumerate(edges)], "edge int, before int, next int, bit int, orders long")
    there = F.col("fails").bitwiseAND(F.col("before")) == 0
    fails = F.col("fails").bitwiseAND(F.col("bit")) != 0

    def rows(when, of: str = "rows"):
        return F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).cast("long")

    return (
        profile.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 1)))).join(F.broadcast(lattice), "edge")
        .groupBy("part", "before", "next", "orders")
        .agg(
            rows(there & ~fails).alias("kept"), rows(there & fails).alias("removed"), rows(~there & fails).alias("redundant"), rows(F.col("fails") == F.col("bit")).alias("unique_fails"),
            rows(there & fails & F.col("good")).alias("good_lost"), rows(there & fails & F.col("toxic")).alias("toxic_lost"),
        )
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 200) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    judged = failures(docs, id_col, text_col, part_col, least_words)
    marks = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = judged.join(marks, "doc_id", "left")
    profile = known.groupBy("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("rows"))
    edges = edge_counts(profile)
    shapley = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [("".join(order), k + 1, sum(1 << FILTERS.index(c) for c in order[:k]), FILTERS.index(order[k])) for order in permutations(FILTERS) for k in range(len(FILTERS))]
    paths = spark.createDataFrame(steps, "filter_order string, step int, before int, next int")
    return (
        edges.join(shapley, ["part", "next"]).join(F.broadcast(paths), ["before", "next"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
