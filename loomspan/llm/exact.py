"""Exact dedup (operator 5): Patricia-trie owners.

Texts are dealt to partitions by byte length and 64-bit content hash.  Every partition inserts full byte strings into
one compressed radix trie, whose terminal nodes hold the smallest and the largest identifier and the number of rows,
so texts are equal exactly if they end at the same node, whatever a hash says.  Tries are built twice: in each map
task, which folds copies before anything is shuffled, and in each partition after the shuffle, where a group of copies
arrives as one row per task.  A trie that outgrows ``budget`` bytes cuts off its heaviest subtree and sends it on: a map
task sends what it has so far, and a partition, which reads its texts in order of length and hash, sends owners that
are settled.

Cases: a null text is the empty text; null ids never own a group unless all are null; of rows that repeat both the id and
the text of an owner exactly one is kept; an empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import text_digest, width

#: What a node weighs beside its bytes.
_NODE = 400


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, step = 0, 64
    while a[lo : lo + step] == b[lo : lo + step]:
        lo, step = lo + step, step * 2
    hi = min(n, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("children", "first", "label", "last", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.rows, self.first, self.last = label, {}, 0, None, None


class PatriciaTrie:
    """A compressed radix trie over bytes; every edge carries the run of bytes to the next branching.

    ``weight`` is the bytes held under each first byte, ``held`` their sum."""

    def __init__(self) -> None:
        self.root, self.held, self.weight = Node(b""), 0, {}

    def insert(self, text: bytes, first: int | None, last: int | None, rows: int = 1) -> Node:
        node, at, end, grown = self.root, 0, len(text), 0
        while at < end:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:] if at else text)
                grown, at = grown + end - at + _NODE, end
            elif text.startswith(child.label, at):
                at += len(child.label)
            else:
                same = common_prefix(child.label, text[at : at + len(child.label)])
                split = node.children[text[at]] = Node(child.label[:same])
                child.label = child.label[same:]
                split.children[child.label[0]] = child
                child, grown, at = split, grown + _NODE, at + same
            node = child
        if grown:
            self.weight[text[0]] = self.weight.get(text[0], 0) + grown
            self.held += grown
        node.rows += rows
        node.first = first if node.first is None else node.first if first is None else min(node.first, first)
        node.last = last if node.last is None else node.last if last is None else max(node.last, last)
        return node

    def terminals(self, node: Node | None = None) -> Iterator[tuple[bytes, Node]]:
        stack = [(node or self.root, b"")]
        while stack:
            node, text = stack.pop()
            text += node.label
            if node.rows:
                yield text, node
            stack.extend((c, text) for c in node.children.values())

    def spill(self) -> list[tuple[bytes, Node]]:
        """Cut off the heaviest subtree under the root, with the root's own terminal, and return its terminals."""
        out = [(b"", self.root)] if self.root.rows else []
        if out:
            kept, self.root = self.root.children, Node(b"")
            self.root.children = kept
        if self.weight:
            key = max(self.weight, key=self.weight.get)
            self.held -= self.weight.pop(key)
            out += self.terminals(self.root.children.pop(key))
        return out


_KINDS = {"text": pa.binary(), "first": pa.int64(), "last": pa.int64(), "rows": pa.int64(), "digest": pa.binary()}


def _batches(rows: Iterator[tuple], names: list[str], weight: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``weight`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
        if size >= weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*held, strict=True), strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*held, strict=True), strict=True)], names=names)


def _fold(budget: int):
    """Map side: texts, identifiers and rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()

        def folded() -> Iterator[tuple]:
            for b in batches:
                for i, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                    trie.insert(text.as_py(), i, i)
                    while trie.held > budget:
                        yield from ((t, n.first, n.last, n.rows) for t, n in trie.spill())
            while found := trie.spill():
                yield from ((t, n.first, n.last, n.rows) for t, n in found)

        yield from _batches(folded(), ["text", "first", "last", "rows"])

    return run


def _settle(budget: int):
    """After the shuffle: texts of one partition in order of length and hash; a subtree is only cut off between two
    hashes, when all copies of what the trie holds have met in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()

        def settled() -> Iterator[tuple]:
            reading = None
            for b in batches:
                keys = zip(b.column("size").to_pylist(), b.column("content").to_pylist(), strict=True)
                for key, text, first, last, rows in zip(keys, b.column("text"), *(b.column(c).to_pylist() for c in ("first", "last", "rows")), strict=True):
                    if trie.held > budget and key != reading:
                        while trie.held > budget // 2:
                            yield from ((hashlib.sha256(t).digest(), n.first, n.last, n.rows) for t, n in trie.spill())
                    reading = key
                    trie.insert(text.as_py(), first, last, rows)
            while found := trie.spill():
                yield from ((hashlib.sha256(t).digest(), n.first, n.last, n.rows) for t, n in found)

        yield from _batches(settled(), ["digest", "first", "last", "rows"])

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """One row per distinct text: digest, first (smallest id), last (largest id), rows.  Ids are whole numbers; others are an error."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{id_col} must be a whole number")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    folded = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(_fold(budget), "text binary, first long, last long, rows long")
    return (
        folded.select(F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("content"), "*")
        .repartition(width(docs.sparkSession), "size", "content")
        .sortWithinPartitions("size", "content")
        .mapInArrow(_settle(budget), "digest binary, first long, last long, rows long")
    )


def decided(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id and text: doc_id, digest, rows (that have both), keep_id, group_size, kept."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    owner = owners(docs, id_col, text_col).select("digest", F.col("last" if keep == "largest" else "first").alias("keep_id"), F.col("rows").alias("group_size"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(owner, "digest").select("doc_id", "digest", "rows", "keep_id", "group_size", F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.  ``keep``: largest or smallest id stays.

    Rows that repeat id and text are written out again in pieces of ``piece``, the first of them as the kept one.
    """
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / piece).cast("long")))
    one = F.explode(F.sequence(F.col("part") * piece, F.least(F.col("rows"), (F.col("part") + 1) * piece) - 1))
    rows = decided(docs, keep, id_col, text_col).withColumn("part", part).withColumn("one", one)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("kept") & (F.col("one") == 0)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
