"""Quality classifier (operator 8): a compression classifier.

One zstandard dictionary is built from good and one from bad labelled text.  A text is cut into blocks, every block is
compressed with either dictionary, and the total difference of compressed sizes, divided by the text's length, is the
raw score: how many bytes a byte the good dictionary saves.  An isotonic map fitted on labelled texts that the
dictionaries have not seen turns it into a probability.

Fitting uses at most ``fit_rows`` labelled rows of at most ``fit_chars`` characters; scoring reads whole texts.
Cases: a null or empty text is scored as a block of no bytes; rows without label, and ids that are null or repeat, are
scored like any other; without both classes in the sample every score is the share of class 1 (0.5 with no labels);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textops
from loomspan.llm.common import remainder
from loomspan.llm.sampling import labelled_sample


class Model(NamedTuple):
    bad: bytes
    good: bytes
    raw: np.ndarray
    probability: np.ndarray
    block: int
    level: int


def _dictionary(texts: list[bytes], size: int, piece: int = 256) -> bytes:
    pieces = [t[i : i + piece] for t in texts for i in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained dictionary
        return b"".join(pieces)[-size:]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.coders = [
            zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            for d in (model.bad, model.good)
        ]

    def raw(self, text: bytes) -> float:
        bad, good, n = self.coders[0].compress, self.coders[1].compress, self.model.block
        view = memoryview(text)
        gain = sum(len(bad(view[i : i + n])) - len(good(view[i : i + n])) for i in range(0, max(len(text), 1), n))
        return gain / (len(text) + 20)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.model.raw, self.model.probability) if len(self.model.raw) else np.full(len(raw), float(self.model.probability[0]))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and mean y of each pool, smoothed by half an example of either class."""
    order = np.argsort(x, kind="stable")
    w = np.ones(len(x)) if weight is None else weight
    pools: list[list[float]] = []
    for a, b, c in zip(*((z * w)[order].tolist() for z in (x, y)), w[order].tolist(), strict=True):
        pools.append([a, b, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], (p[:, 1] + 0.5) / (p[:, 2] + 1)


def fit(sample: list[tuple[str, int]], share: float | None = None, size: int = 112 << 10, block: int = 512, level: int = 3) -> Model:
    """Dictionaries of ``size`` bytes from all texts of the first half of the sample, calibration from the second, with
    rows weighted so that ``share`` of them are of class 1 (as many as in the sample if it is not given)."""
    classes = {y for _, y in sample}
    if len(classes) < 2:
        return Model(b"", b"", np.zeros(0), np.array([float(classes.pop()) if classes else 0.5]), block, level)
    half = [*range(0, len(sample), 2)], [*range(1, len(sample), 2)]
    built = [(t.encode(), y) for t, y in (sample[i] for i in half[0])]
    if len({y for _, y in built}) < 2:
        built = [(t.encode(), y) for t, y in sample]
    scorer = Scorer(Model(*(_dictionary([t for t, y in built if y == c], size) for c in (0, 1)), np.zeros(0), np.zeros(1), block, level))
    held = [sample[i] for i in half[1]]
    y = np.array([y for _, y in held], float)
    now = y.mean()
    weight = np.where(y == 1, share / now, (1 - share) / (1 - now)) if share is not None and 0 < now < 1 else np.ones(len(y))
    x, p = isotonic(np.array([scorer.raw(t.encode()) for t, _ in held]), y, weight)
    return scorer.model._replace(raw=x, probability=np.maximum.accumulate(p))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, raw_gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            buf, offsets = textops.buffers(b.column("text"))
            if not len(model.raw):
                raw = np.zeros(b.num_rows)
            else:
                raw = np.array([scorer.raw(textops.text_of(buf, offsets, i)) for i in range(b.num_rows)], float)
            score = scorer.scores(raw)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(raw)], names=["doc_id", "score", "predicted", "raw_gain"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int, raw_gain double")


def classify_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000, fit_chars: int = 20_000, folds: int = 5, held: int = 0) -> DataFrame:
    """Fit on labelled rows outside the held-out fold and score all documents; adds held_out."""
    sample = labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), folds) != held, fit_rows, fit_chars)
    scored = score_quality(docs, fit(*sample))
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted", "raw_gain")
