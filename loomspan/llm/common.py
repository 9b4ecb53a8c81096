"""Small helpers shared by the operators: table reading, shuffle width, lineage cuts, dropping rows by id and text."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.lineage import cut, shared_folder

__all__ = ["cut", "keep_one", "remainder", "remove", "shared_folder", "table", "text_bytes", "text_digest", "width"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one pass that sends one number to the driver."""
    return int(df.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0)


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, 32 bytes; a null text counts as the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def keep_one(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``decided`` keeps.

    ``decided`` has one row for each id (null counts as a value) and text: doc_id, digest, rows (of ``docs`` that have
    both), kept.  Of rows that have both in common one stays.  Joins are on id and digest, so a hot text is no hot key.
    """
    key = f"_{uuid4().hex}"
    decided = cut(decided.select("doc_id", "digest", "rows", "kept"))
    digest = text_digest(docs[text_col])

    def part(where: str) -> tuple[DataFrame, Column]:
        some = decided.where(where).select(F.col("doc_id").alias(f"{key}i"), F.col("digest").alias(f"{key}d"))
        return some, docs[id_col].eqNullSafe(some[f"{key}i"]) & (digest == some[f"{key}d"])

    once = docs.join(*part("kept AND rows > 1"), "left_semi").withColumn(key, digest).dropDuplicates([id_col, key]).drop(key)
    return docs.join(*part("NOT kept OR rows > 1"), "left_anti").unionByName(once)
