"""Splits, weights, baselines and training of the noise classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.operators.metrics import confusion_at, min_max
from hearthgrid.operators.neighbours import HOUR_US, micros
from hearthgrid.operators.ordered import grouped_rank, quantiles, running_totals


def bad_labels(df: DataFrame, label: str = "label_numeric") -> DataFrame:
    ok = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    return df.agg(F.count_if(~ok).alias("bad_labels"), F.count(F.lit(1)).alias("labels"))


def score_summary(df: DataFrame, score: str, noise: str) -> DataFrame:
    """Count, mean, exact median, range, noise count and percent, as one row."""
    base = df.agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"),
                  F.count_if(F.col(noise)).alias("noise"))
    median = quantiles(df, score, {"median": 0.5}).select("median").scalar()
    return base.withColumns({"median": median, "noise_pct": F.lit(100.0) * F.col("noise") / F.col("n")})


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced sample weight n / (2 n_c) per class, and the positive rate."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.sum(F.when(F.col(y) == 1, F.col("n")).otherwise(0)).alias("pos")).alias("t")).scalar()
    return counts.withColumns({"weight": totals["n"] / (F.lit(2.0) * F.col("n")), "pos_rate": totals["pos"] / totals["n"]})


def with_sample_weight(df: DataFrame, y: str) -> DataFrame:
    """Add ``weight`` from one-row class counts."""
    n = df.agg(F.struct(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")).alias("c")).scalar()
    both = (n["pos"] > 0) & (n["neg"] > 0)
    balanced = (n["pos"] + n["neg"]) / (F.lit(2.0) * F.when(F.col(y) == 1, n["pos"]).otherwise(n["neg"]))
    return df.withColumn("weight", F.when(both, balanced).otherwise(F.lit(1.0)))


def baseline_metrics(df: DataFrame, y: str, columns: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Single-column scorers, scaled to [0, 1], at each threshold."""
    scaled = min_max(df, columns)
    out = None
    for c in columns:
        part = confusion_at(scaled, y, c, thresholds).select(F.lit(c).alias("baseline"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def top_errors(df: DataFrame, y: str, p: str, k: int) -> DataFrame:
    """The k most confident false positives and false negatives."""
    fp = df.where(F.col(y) == 0).orderBy(F.desc(p), "id").limit(k).select(F.lit("fp").alias("kind"), "*")
    fn = df.where(F.col(y) == 1).orderBy(F.asc(p), "id").limit(k).select(F.lit("fn").alias("kind"), "*")
    return fp.unionByName(fn)


def time_quantile(df: DataFrame, time: str, share: float) -> DataFrame:
    """Exact time quantile (linear interpolation), one row ``split_us``; rows fold per instant."""
    return quantiles(df.select(micros(F.col(time)).alias("t")), "t", {"split_us": share})


def split_at_quantile(df: DataFrame, time: str = "acq_time", share: float = 0.8, fallback: float = 0.7, gap_hours: int = 0) -> DataFrame:
    """Add ``part``: train before the quantile, eval from quantile + gap on, null inside the gap.

    A quantile on the edge of the observed range is replaced by the fallback share.
    """
    both = quantiles(df.select(micros(F.col(time)).alias("t")), "t", {"a": share, "b": fallback, "lo": 0.0, "hi": 1.0}).select(F.struct("a", "b", "lo", "hi").alias("q"))
    q = both.scalar()
    cut = F.when((q["a"] <= q["lo"]) | (q["a"] >= q["hi"]), q["b"]).otherwise(q["a"])
    at = micros(F.col(time)).cast("double")
    return df.withColumn("part", F.when(at < cut, "train").when(at >= cut + F.lit(gap_hours * HOUR_US), "eval"))


def split_at(df: DataFrame, when: str, gap_hours: int = 0, time: str = "acq_time") -> DataFrame:
    cut = F.lit(when).cast("timestamp_ntz")
    late = cut + F.make_dt_interval(F.lit(0), F.lit(gap_hours))
    return df.withColumn("part", F.when(F.col(time) < cut, "train").when(F.col(time) >= late, "eval"))


def split_by_time_steps(df: DataFrame, time: str, share: float) -> DataFrame:
    """First ``int(n * share)`` distinct times are train, the rest validation."""
    steps = df.select(time).distinct().withColumns({"one": F.lit(1), "_us": micros(F.col(time))})
    ranked = running_totals(steps, "_us", ["one"])
    part = F.when(F.col("upto_one") <= F.floor(F.col("all_one") * F.lit(share)), "train").otherwise("validation")
    return df.join(ranked.select(time, part.alias("part")), time)


def split_stratified(df: DataFrame, y: str, key: str, eval_share: float, seed: int) -> DataFrame:
    """Deterministic random split with both classes in eval.

    Rows are ordered by md5(key|seed). The first row of each class goes to eval, and the rest of eval is
    filled in hash order. With fewer than two rows in a class the hash order alone decides.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    s = hashed.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"),
        F.min(F.when(F.col(y) == 1, F.col("_h"))).alias("first_pos"), F.min(F.when(F.col(y) == 0, F.col("_h"))).alias("first_neg"),
    ).alias("s")).scalar()
    wanted = F.greatest(F.lit(1), F.least(s["n"] - 1, F.ceil(F.lit(eval_share) * s["n"])))
    force = (s["pos"] >= 2) & (s["neg"] >= 2) & (wanted >= 2)
    seeded = force & ((F.col("_h") == s["first_pos"]) | (F.col("_h") == s["first_neg"]))
    # Seeded rows first, the others by hash.
    marked = hashed.withColumn("_order", F.concat(F.when(seeded, "").otherwise("~"), F.col("_h")))
    ranked = grouped_rank(marked, [], "_order", "_rank")
    return ranked.withColumn("part", F.when(F.col("_rank") <= wanted, "eval").otherwise("train")).drop("_h", "_order", "_rank")
