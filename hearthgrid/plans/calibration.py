"""Calibration of spread probabilities: candidates, fit, application, evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthgrid.operators.metrics import brier, calibration_error, probability_bin

#: Bins of probability in which rows meet the pieces of a curve.
CURVE_BINS = 1024


def candidates(cells: DataFrame, p_min: float) -> DataFrame:
    return cells.where((F.col("fire_t0") > 0) | (F.col("y_pred") >= p_min))


def binned_knots(cells: DataFrame) -> DataFrame:
    """Monotone calibration curve from ten probability bins: knots (horizon_h, x, y), at most ten for each horizon."""
    bins = cells.groupBy("horizon_h", probability_bin(F.col("y_pred")).alias("bin")).agg(F.avg("y_pred").alias("x"), F.avg("y_obs").alias("y"))
    rising = Window.partitionBy("horizon_h").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bins.withColumn("y", F.max("y").over(rising)).select("horizon_h", "x", "y")


def _bin(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * F.lit(float(CURVE_BINS))).cast("int")


def segments(knots: DataFrame) -> DataFrame:
    """The pieces between knots, listed under every bin of probability they touch, with open ends on both sides.

    Within a horizon the knots follow each other, so a piece needs its neighbour only; where the curve is flat or
    knots are dense, pieces fall into few bins each.
    """
    order = Window.partitionBy("horizon_h").orderBy("x")
    paired = knots.withColumns({"x1": F.lead("x").over(order), "y1": F.lead("y").over(order), "first": F.row_number().over(order) == 1})
    none = F.lit(None).cast("double")
    here = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
    before = F.struct(none.alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    listed = paired.select("horizon_h", F.explode(F.when(F.col("first"), F.array(before, here)).otherwise(F.array(here))).alias("s")).select("horizon_h", "s.*")
    low, high = _bin(F.coalesce("x0", F.lit(0.0))), _bin(F.coalesce("x1", F.lit(1.0)))
    return listed.withColumn("bin", F.explode(F.sequence(low, high)))


def apply_knots(cells: DataFrame, knots: DataFrame, p: str = "y_pred", out: str = "y_cal") -> DataFrame:
    """Piecewise linear between knots, constant outside; the raw value where a horizon has no knots; clipped to [0, 1].

    Rows meet the pieces of their bin of probability, never a whole curve.
    """
    pieces = segments(knots).withColumnsRenamed({"horizon_h": "_h", "bin": "_bin"})
    value = F.col(p)
    inside = (F.col("_h") == F.col("horizon_h")) & (F.col("_bin") == _bin(value)) & (F.col("x0").isNull() | (F.col("x0") <= value)) & (F.col("x1").isNull() | (value < F.col("x1")))
    between = F.col("y0") + (F.col("y1") - F.col("y0")) * (value - F.col("x0")) / (F.col("x1") - F.col("x0"))
    shaped = F.when(F.col("_h").isNull(), value).when(F.col("x0").isNull() | F.col("x1").isNull(), F.col("y0")).otherwise(between)
    met = cells.join(pieces, inside, "left")
    return met.withColumn(out, F.when(value.isNotNull(), F.least(F.greatest(shaped, F.lit(0.0)), F.lit(1.0)))).select(*cells.columns, out)


@dataclass(frozen=True)
class Calibrator:
    """Knots (horizon_h, x, y) of isotonic fits and ``a + b x`` inside the logistic curve of Platt fits (horizon_h, a, b)."""

    knots: DataFrame
    curves: DataFrame


def apply(cells: DataFrame, calibrator: Calibrator, p: str = "y_pred", out: str = "y_cal") -> DataFrame:
    """The calibrated probability of every row; horizons without a fit keep the raw one, clipped to [0, 1]."""
    bent = apply_knots(cells, calibrator.knots, p, out)
    curve = calibrator.curves.select(F.col("horizon_h"), F.struct("a", "b").alias("_curve"))  # a row per horizon
    logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_curve.a") + F.col("_curve.b") * F.col(p))))
    met = bent.join(curve, "horizon_h", "left")
    return met.withColumn(out, F.when(F.col("_curve").isNotNull() & F.col(p).isNotNull(), logistic).otherwise(F.col(out))).select(*cells.columns, out)


def save(calibrator: Calibrator, path: str) -> str:
    calibrator.knots.write.parquet(f"{path}/knots")
    calibrator.curves.write.parquet(f"{path}/curves")
    return path


def load(spark: SparkSession, path: str) -> Calibrator:
    return Calibrator(spark.read.schema("horizon_h int, x double, y double").parquet(f"{path}/knots"), spark.read.schema("horizon_h int, a double, b double").parquet(f"{path}/curves"))


def evaluate(cells: DataFrame, raw: str = "y_pred", cal: str = "y_cal") -> DataFrame:
    """Brier score and expected calibration error per horizon, raw and calibrated."""
    scores = cells.groupBy("horizon_h").agg(brier("y_obs", raw).alias("brier_raw"), brier("y_obs", cal).alias("brier_cal"))
    ece_raw = calibration_error(cells, "y_obs", raw, ["horizon_h"]).select("horizon_h", F.col("ece").alias("ece_raw"), "n")
    ece_cal = calibration_error(cells, "y_obs", cal, ["horizon_h"]).select("horizon_h", F.col("ece").alias("ece_cal"))
    return scores.join(ece_raw, "horizon_h").join(ece_cal, "horizon_h")


def oldest_cases(cells: DataFrame, share: float, case: str = "ref_time") -> DataFrame:
    """Flag rows of the oldest ``int(n * share)`` cases."""
    from hearthgrid.plans.training import split_by_time_steps
    return split_by_time_steps(cells, case, share)


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators over rows (horizon_h, low, high, weight, total) sorted by horizon and low.

    Only the blocks of one horizon are held. A block's mean is compared as a fraction of its sums.
    """
    names = ["horizon_h", "low", "high", "weight", "total"]
    blocks: list[list] = []
    horizon = None

    def done() -> pa.RecordBatch:
        low, high, weight, total = zip(*blocks)
        return pa.RecordBatch.from_arrays([pa.array([horizon] * len(blocks), pa.int32()), *[pa.array(c, pa.float64()) for c in (low, high, weight, total)]], names)

    for batch in batches:
        for h, *block in zip(*[c.to_pylist() for c in batch.columns]):
            if h != horizon:
                if blocks:
                    yield done()
                blocks, horizon = [], h
            while blocks and blocks[-1][3] * block[2] >= block[3] * blocks[-1][2]:
                low, _, weight, total = blocks.pop()
                block = [low, block[1], weight + block[2], total + block[3]]
            blocks.append(block)
    if blocks:
        yield done()


def isotonic_knots(train: DataFrame, p: str = "y_pred", y: str = "y_obs") -> DataFrame:
    """Knots (horizon_h, x, y) of the least-squares non-decreasing fit of each horizon.

    Rows fold per probability. Each range of probabilities is pooled by the task that holds it; the few blocks that
    are left are pooled again where the ranges meet. The result does not depend on where they were cut. A block gives
    its value at its first and last probability; rows without a probability or outcome take no part.
    """
    spark = train.sparkSession
    schema = "horizon_h int, low double, high double, weight double, total double"
    value = F.col(p).cast("double")
    folded = train.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy("horizon_h", value.alias("low")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col(y).cast("double")).alias("total"))
    rows = folded.select(F.col("horizon_h").cast("int").alias("horizon_h"), "low", F.col("low").alias("high"), "weight", "total")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(tasks, "horizon_h", "low").sortWithinPartitions("horizon_h", "low").mapInArrow(_pool, schema)
    blocks = ranges.repartition("horizon_h").sortWithinPartitions("horizon_h", "low").mapInArrow(_pool, schema)
    ends = F.array_distinct(F.array("low", "high"))
    return blocks.select("horizon_h", F.explode(ends).alias("x"), (F.col("total") / F.col("weight")).alias("y"))


def fit(train: DataFrame, method: str = "isotonic") -> Calibrator:
    """One calibrator per horizon. Platt scaling needs both classes; a horizon with one class gets the isotonic fit."""
    if method not in ("isotonic", "platt"):
        raise ValueError(f"unknown calibration method: {method}")
    spark, rows = train.sparkSession, []
    if method == "platt":
        classes = train.groupBy("horizon_h").agg(F.count_distinct(F.col("y_obs") > 0.5).alias("n")).where("n = 2").collect()  # one row per horizon
        for horizon, _ in sorted(map(tuple, classes)):
            data = VectorAssembler(inputCols=["y_pred"], outputCol="features").transform(train.where(F.col("horizon_h") == horizon))
            fitted = LogisticRegression(labelCol="y_obs", featuresCol="features", maxIter=200, tol=1e-12).fit(data)
            rows.append((horizon, float(fitted.intercept), float(fitted.coefficients[0])))
    curves = spark.createDataFrame(rows, "horizon_h int, a double, b double")
    return Calibrator(isotonic_knots(train.where(~F.col("horizon_h").isin([r[0] for r in rows])) if rows else train), curves)
