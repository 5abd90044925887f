"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.frames import materialize

MOST_ROUNDS = 60


def _lowest(links: DataFrame) -> DataFrame:
    """``(u, v, low)``: both directions of the links and the smallest of ``u`` and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low"))
    return both.join(low, "u")


def _large_star(links: DataFrame) -> DataFrame:
    return _lowest(links).filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are tied to the smallest of them. Links have a > b here."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    tied = links.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return tied.union(low.select("a", F.col("low").alias("b"))).filter("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node of its component.

    Neighbours are never gathered: each round takes minima and joins them back, so a hub is a skewed join at most,
    which adaptive execution splits. Every round is written to the shared folder. Links of a node with itself are ignored; no links
    give no rows.
    """
    current = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b"), F.col("b"))).distinct()
        seen = mark
        current = materialize(_small_star(_large_star(current).distinct()).distinct(), "links")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
