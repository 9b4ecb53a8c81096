"""Sharding (operator 7): jump consistent hashing.

``assign_shards`` maps a stable integer key to a shard without a table of ring points: the key seeds a 64-bit linear
congruential generator, and the last jump that stays below the shard count is the shard.  With one more shard, a row
either stays or moves to the new shard; about 1/(n + 1) of the rows move.

Cases: a null key is hashed as key 0; a null text has no bytes and the crc of the empty string; repeated rows each
get a slot of their own; an empty table gives no rows; columns of the input other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import cut, width


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards``, vectorised over keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Slots run without gaps from 0 in every shard.  A shard is numbered in pieces, each piece in one task, and a small
    table of piece sizes (shards x shuffle partitions rows) turns positions in a piece into positions in the shard,
    so no task holds a whole shard.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{id_col} must be a whole number, as it is the key")
    spark = docs.sparkSession
    pieces = width(spark)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(jump(keys, shards).astype(np.int32)), pa.array(jump(keys, shards + 1).astype(np.int32))],
                names=[*b.schema.names, "shard", "grown_shard"],
            )

    id_type = dict(base.dtypes)["doc_id"]
    placed = base.mapInArrow(place, f"doc_id {id_type}, size long, text_crc32 long, shard int, grown_shard int")
    placed = cut(placed.withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(pieces)).cast("int")))  # both uses below read this
    in_shard = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows"))
        .select("shard", "piece", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("before"))
    )
    in_piece = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(in_piece) - 1)
        .join(offsets, ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )
