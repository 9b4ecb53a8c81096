"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import cut


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, chars: int) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of at most ``rows`` labelled documents of at most ``chars`` characters, in a fixed order, and the
    share of label 1 among all such documents.

    ``keep`` is a condition on ``doc_id``; ids labelled both ways are left out.  Rows are drawn among documents whose text
    exists and fits: up to half of them of either class, and where a class has fewer, more of the other.  The draw is on
    ids; then the texts of the drawn ids (at most ``rows``, which are broadcast) are read, so rows x chars bounds what
    reaches the driver and no text is shuffled that was not drawn.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    fits = docs.where((F.length("text") > 0) & (F.length("text") <= chars))
    there = cut(known.select("doc_id", F.col("y").cast("int").alias("y")).join(fits.select("doc_id"), "doc_id", "left_semi"))
    many = {r["y"]: r["n"] for r in there.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = many.get(1, 0), many.get(0, 0)
    take = min(ones, max(rows // 2, rows - zeros))
    drawn = [tuple(r) for y, k in ((1, take), (0, min(zeros, rows - take))) if k for r in there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k).collect()]
    if not drawn:
        return [], 0.0
    chosen = docs.sparkSession.createDataFrame(drawn, there.schema)
    found = fits.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return [(r["text"], int(r["y"])) for r in found.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect()], ones / (ones + zeros)
