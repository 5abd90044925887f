"""Order statistics without a global sort in one task.

Values are folded to one row per distinct value first and dealt out by ranges, whose edges Spark takes from a sample of the
values themselves: however they are spread, each task holds about as many. Running totals are then taken
inside each range and over the totals of the ranges. Only those totals - one row per task - ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthgrid.session import materialize


def dealt_by_range(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``_range``, the number of the range of ``order`` they lie in; written, so that all readers see one dealing."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()), "by-range")


def running_totals(folded: DataFrame, value: str, sums: Sequence[str]) -> DataFrame:
    """Add ``upto_<s>`` (inclusive running total in value order) and ``all_<s>`` for each sum column."""
    placed = dealt_by_range(folded, value)
    totals = placed.groupBy("_range").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(
        "_range",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_base_{s}") for s in sums],
        *[F.sum(s).over(everything).alias(f"all_{s}") for s in sums],
    )
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({f"_in_{s}": F.sum(s).over(inside) for s in sums})
    out = local.join(bases, "_range").withColumns({f"upto_{s}": F.col(f"_base_{s}") + F.col(f"_in_{s}") for s in sums})
    return out.drop("_range", *[f"_base_{s}" for s in sums], *[f"_in_{s}" for s in sums])


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as one row with one column per name."""
    folded = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(folded, value, ["n"])
    aggs = []
    for name, share in shares.items():
        at = (F.col("all_n") - 1) * F.lit(share)

        def held(rank):
            return F.max(F.when((F.col("upto_n") > rank) & (F.col("upto_n") - F.col("n") <= rank), F.col(value)))

        low, high = held(F.floor(at)), held(F.ceil(at))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return ranked.agg(*aggs)


def grouped_rank(df: DataFrame, keys: Sequence[str], order: str, out: str = "rank") -> DataFrame:
    """Exact rank inside each group in the order of a unique column, without one window per whole group.

    Rows are dealt by ranges of (keys, order) and ranked inside (group, range); the sizes of a group's ranges before are added.
    """
    placed = dealt_by_range(df, *keys, order)
    sizes = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    ranked = placed.withColumn("_local", F.row_number().over(inside))
    return ranked.join(bases, [*keys, "_range"]).withColumn(out, F.col("_base") + F.col("_local")).drop("_range", "_base", "_local")
