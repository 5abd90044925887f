"""A bounded sample of labelled texts for fitting classifiers, and small fitting helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are not learned from (they are scored whole all the same).
LONGEST_LEARNED = 200_000


def fold(modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a missing doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, learned: Column, rows: int) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most ``rows`` labelled texts of each class, and how many labelled rows each class has in all.

    ``learned`` says which rows may be learned from. The rows with the smallest hashes of their doc_id are taken, in
    that order, so the sample is random, bounded and the same in every run. A doc_id that has several labels counts with the
    highest; null labels and doc_ids are left out.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(learned)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    totals = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ranked = known.withColumn("rank", F.xxhash64("doc_id"))
    parts = [ranked.filter(F.col("label") == k).orderBy("rank", "doc_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 * rows numbers
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST_LEARNED)
    found = texts.orderBy("rank", "doc_id", F.xxhash64("text")).limit(2 * rows).select("text", "label").collect()
    return [((r["text"] or "").encode(), int(r["label"])) for r in found], totals


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, rounds: int = 80) -> np.ndarray:
    """Intercept and coefficients of a weighted, ridge-penalised logistic regression (Newton steps)."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (weight * (p - y)) + ridge * beta)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def prior(totals: dict[int, int]) -> float:
    """Share of label 1, one half where nothing is known."""
    return (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
