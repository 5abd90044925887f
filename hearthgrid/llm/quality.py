"""Compression classifier: zstandard dictionaries of good and of bad text, and which of them packs a text smaller.

Every text is cut into blocks of ``BLOCK`` bytes, each compressed with either dictionary, so that a long text cannot
learn its own statistics and outweigh the dictionaries. From the two sums of compressed sizes come the normalised
difference ``(bad - good) / (bad + good)``, its square, bytes out per byte in under the good dictionary, the share of blocks that
the bad dictionary packs smaller, and a term for short texts; a logistic fit on labelled rows that the dictionaries
have not seen turns them into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.batches import texts
from hearthgrid.llm.frames import documents, labels
from hearthgrid.llm.labelled import fold, logistic, prior, sample, sigmoid

QUERY = "op7_quality"
ORACLE_SQL = None

#: At most so many labelled rows of each class are learned from; two thirds make dictionaries, the others calibrate.
SAMPLE_ROWS = 1500
#: Blocks per dictionary, bytes per block and per dictionary, compression level.
DICTIONARY_BLOCKS, BLOCK, DICTIONARY_BYTES, LEVEL = 24_000, 128, 32_768, 3
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(items: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES trained on evenly chosen blocks; few blocks serve as raw content."""
    pool = [b for text in items for b in blocks(text)]
    if len(pool) > DICTIONARY_BLOCKS:
        pool = [pool[i] for i in np.random.default_rng(7).permutation(len(pool))[:DICTIONARY_BLOCKS]]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pool)) // 8))
    try:
        return zstandard.train_dictionary(size, pool).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pool)[-DICTIONARY_BYTES:]


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(raw)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False)


@dataclass
class QualityModel:
    """``beta`` is None where only one class, or none, was there to learn from; then every score is ``base``."""

    good: bytes
    bad: bytes
    beta: np.ndarray | None
    base: float

    def features(self, items: list[bytes]) -> np.ndarray:
        good, bad = compressor(self.good), compressor(self.bad)
        rows = np.zeros((len(items), 5))
        for k, text in enumerate(items):
            cut = blocks(text)
            if not cut:
                rows[k] = 0, 1, 0, 0, 1
                continue
            g = np.array([len(good.compress(b)) for b in cut], dtype=np.int64)
            b = np.array([len(bad.compress(b)) for b in cut], dtype=np.int64)
            d = (b.sum() - g.sum()) / (b.sum() + g.sum())
            rows[k] = d, g.sum() / len(text), d * d, (b < g).mean(), min(1.0, 200 / len(text))
        return rows

    def scores(self, items: list[bytes]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(items), self.base)
        x = self.features(items)
        out = sigmoid(self.beta[0] + x @ self.beta[1:])
        empty = np.array([not t for t in items], dtype=bool)
        return np.where(empty, self.base, out)


def fit(labelled: list[tuple[bytes, int]], totals: dict[int, int]) -> QualityModel:
    """Dictionaries from two thirds of the sample, calibration from the rest, weighted back to the classes' real shares."""
    sides = {k: [t for t, y in labelled if y == k and t] for k in (0, 1)}
    if min(map(len, sides.values())) < 3:
        return QualityModel(b"", b"", None, prior(totals))
    cut = {k: 2 * len(v) // 3 for k, v in sides.items()}
    model = QualityModel(dictionary(sides[1][:cut[1]]), dictionary(sides[0][:cut[0]]), None, prior(totals))
    rest = [(t, k) for k, v in sides.items() for t in v[cut[k]:]]
    y = np.array([k for _, k in rest])
    weight = np.array([totals[k] / max(1, (y == k).sum()) for k in (0, 1)])[y]
    model.beta = logistic(model.features([t for t, _ in rest]), y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row and whole text; empty and null texts score the share of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts(batch.column(1))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train(docs: DataFrame, label_rows: DataFrame) -> QualityModel:
    return fit(*sample(docs, label_rows, "quality", fold(MODULUS) != HELD_OUT, SAMPLE_ROWS))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject (score at least ``threshold``)."""
    columns, types = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = columns.index("text")
        for batch in batches:
            yield batch.filter(pa.array(model.scores(texts(batch.column(place))) >= threshold))

    return docs.mapInArrow(run, types)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the folds of crc32(doc_id) mod 5 other than 0."""
    docs = documents(spark, folder)
    scored = score(docs, train(docs, labels(spark, folder)))
    return scored.select("doc_id", (fold(MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
