"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

N-grams of three to six bytes of the text in lower case (A-Z) are hashed into ``2 ** BITS`` buckets; a feature says
whether a text has the bucket at all. For each bucket the log-count ratio ``r`` compares how often texts of either
label have it. The ``FEATURES`` buckets whose shares differ most for their noise are kept, their presence is scaled by
``r``, and a ridge-penalised logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.batches import LOWER, slices, texts
from hearthgrid.llm.frames import documents, labels
from hearthgrid.llm.labelled import fold, prior, sample, sigmoid

QUERY = "op4_toxicity"
ORACLE_SQL = None

#: At most so many labelled rows of each class are learned from.
SAMPLE_ROWS = 2000
BITS, ORDERS, FEATURES = 18, (3, 4, 5, 6), 4096
MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.7
SLICE = 1 << 19
EDGE = b"\n" * ORDERS[-1]


def grams(items: list[bytes], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket (or, with ``keep``, its kept feature number) of every n-gram, each pair once, in order."""
    padded = [EDGE + t + EDGE for t in items]
    data = LOWER[np.frombuffer(b"".join(padded), dtype=np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(items), dtype=np.int64), [len(t) for t in padded])
    rolled, found = data.copy(), []
    with np.errstate(over="ignore"):
        for n in range(2, ORDERS[-1] + 1):
            rolled = rolled[:-1] * np.uint32(16_777_619) ^ data[n - 1:]
            if n not in ORDERS:
                continue
            bucket = ((rolled * np.uint32(2_654_435_769)) ^ np.uint32(n * 1_000_003)) * np.uint32(3_266_489_909) >> np.uint32(32 - BITS)
            if keep is None:
                found.append(owner[:len(bucket)] << BITS | bucket)
            else:
                number = keep[bucket]
                hit = np.flatnonzero(number >= 0)
                found.append(owner[hit] << BITS | number[hit])
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def all_grams(items: list[bytes], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [(grams(items[lo:hi], keep), lo) for lo, hi in slices(items, SLICE)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([d + lo for (d, _), lo in parts]), np.concatenate([g for (_, g), _ in parts])


@dataclass
class ToxicityModel:
    """``keep`` maps buckets to features (-1: none), ``weight`` is coefficient times log-count ratio."""

    keep: np.ndarray
    weight: np.ndarray
    intercept: float

    def scores(self, items: list[bytes]) -> np.ndarray:
        owner, feature = all_grams(items, self.keep)
        return sigmoid(self.intercept + np.bincount(owner, self.weight[feature], minlength=len(items)))


def fit(labelled: list[tuple[bytes, int]], totals: dict[int, int], l2: float = 1e-4, rounds: int = 200) -> ToxicityModel:
    """Fit the ratios and the regression; with one class only, every score is the share of label 1."""
    y = np.array([k for _, k in labelled], dtype=np.int64)
    base = np.log(prior(totals) / (1 - prior(totals)))
    have = [(y == k).sum() for k in (0, 1)]
    if min(have) == 0:
        return ToxicityModel(np.full(1 << BITS, -1, np.int16), np.zeros(1), base)
    items = [t for t, _ in labelled]
    with_0, with_1 = (np.zeros(1 << BITS, dtype=np.int64) for _ in (0, 1))
    for lo, hi in slices(items, SLICE):  # counted slice by slice: the n-grams of the sample are never held together
        owner, bucket = grams(items[lo:hi])
        positive = y[lo:hi][owner] == 1
        with_1 += np.bincount(bucket[positive], minlength=1 << BITS)
        with_0 += np.bincount(bucket[~positive], minlength=1 << BITS)
    ratio = np.log((with_1 + 1) / (have[1] + 2)) - np.log((with_0 + 1) / (have[0] + 2))
    share = (with_0 + with_1) / len(y)
    noise = np.sqrt(share * (1 - share) * (1 / have[0] + 1 / have[1])) + 1e-9
    strength = np.where(with_0 + with_1 >= 3, np.abs(with_1 / have[1] - with_0 / have[0]) / noise, 0)
    chosen = np.argsort(-strength, kind="stable")[:FEATURES]
    keep = np.full(1 << BITS, -1, dtype=np.int16)
    keep[chosen] = np.arange(FEATURES)
    scale = ratio[chosen]
    owner, feature = all_grams(items, keep)
    row_weight = np.array([totals[k] / have[k] for k in (0, 1)])[y]
    row_weight *= len(y) / row_weight.sum()
    x, beta, intercept = scale[feature], np.zeros(FEATURES), base
    first = second = np.zeros(FEATURES + 1)
    for step in range(1, rounds + 1):  # Adam on the full sample
        p = sigmoid(intercept + np.bincount(owner, beta[feature] * x, minlength=len(y)))
        error = row_weight * (p - y) / len(y)
        slope = np.append(np.bincount(feature, error[owner] * x, minlength=FEATURES) + l2 * beta, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        beta, intercept = beta - move[:-1], intercept - move[-1]
    return ToxicityModel(keep, beta * scale, float(intercept))


def train(docs: DataFrame, label_rows: DataFrame) -> ToxicityModel:
    return fit(*sample(docs, label_rows, "toxic", fold(MODULUS) != HELD_OUT, SAMPLE_ROWS))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row and whole text; null counts as the empty text, which has only the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts(batch.column(1))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the folds of crc32(doc_id) mod 3 other than 1."""
    docs = documents(spark, folder)
    scored = score(docs, train(docs, labels(spark, folder)))
    return scored.select("doc_id", (fold(MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
