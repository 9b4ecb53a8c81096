"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; the result is written as Parquet and read
again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``; the last returns what
the encoder says of each document that is left.  Rows of a filtering stage pass through whole, columns with clashing names
included, and an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import bpe, decontaminate, exact, simhash, toxicity
from loomspan.llm.common import keep_one, shared_folder, table
from loomspan.llm.queries import tokenizer_path
from loomspan.shipping import shipped

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score 0.7 or more go; repeated rows score alike, null and empty texts as one empty
    window.  Labels only count where the crc32 of the id leaves a remainder other than 1 by 3."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts (null counts as empty) exactly one row stays, that with the largest id; null ids go
    unless all are null, and of rows that repeat id and text any one stays.  Long texts are compared whole."""
    return keep_one(docs, exact.decided(docs, keep="largest"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of linked rows exactly one stays, that with the smallest id (null ids last, then the
    smallest digest of the text); ids may repeat, and of rows that repeat id and text any one stays.  Null and empty texts
    are one group with all whose fingerprint is near zero."""
    return keep_one(docs, simhash.near_rows(docs, words_per_shingle=4, within=4))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go; null and empty texts hold none, repeated rows go together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids and decoded text of every document left, as digests; a null text is the empty one."""
    return bpe.digests(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", shipped(drop_toxic)),
    ("exact dedup", shipped(drop_copies)),
    ("SimHash near-dedup", shipped(drop_near_copies)),
    ("benchmark decontamination", shipped(drop_leaks)),
    ("BPE", shipped(encode)),
]
#: The toxicity network has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared checkpoint folder, which goes when
    the stage after has been written.  The table before the last stage stays, as the result reads it."""
    root, before = shared_folder(spark), None
    docs = table(spark, sf_dir, "documents")  # each stage ships the package first, so the last one's plan can run too
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{root}/pipeline-{uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                folder = spark._jvm.org.apache.hadoop.fs.Path(before)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            before = path
    return docs
