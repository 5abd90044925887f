"""Classifier and probability metrics from folded scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthgrid.operators.ordered import running_totals

# Inner edges of ten equal probability bins as a linspace in doubles gives them.
BIN_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row per distinct score with its positives and negatives."""
    return df.groupBy(F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": safe_ratio(2.0 * precision * recall, precision + recall),
        "f0_5": safe_ratio(1.25 * precision * recall, 0.25 * precision + recall),
        "iou": safe_ratio(tp, tp + fp + fn),
        "predicted_positive_rate": safe_ratio(tp + fp, tp + fp + tn + fn),
    }


def threshold_sweep(df: DataFrame, y: str, p: str, steps: int = 100) -> DataFrame:
    """Counts and rates at thresholds 0, 1/steps, ..., 1: one grouped count, then a sum over steps + 1 rows."""
    guess = F.floor(F.col(p) * steps)
    at = F.when((guess + 1) / F.lit(float(steps)) <= F.col(p), guess + 1).when(guess / F.lit(float(steps)) > F.col(p), guess - 1).otherwise(guess)
    binned = df.select(F.least(at, F.lit(steps)).alias("k"), F.col(y).alias("y")).groupBy("k").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    grid = df.sparkSession.range(steps + 1).withColumnRenamed("id", "k")
    filled = grid.join(binned, "k", "left").fillna(0, ["pos", "neg"])
    below_zero = binned.where("k < 0")
    filled = filled.unionByName(below_zero)
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = filled.select(
        "k", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(all_rows).alias("all_pos"), F.sum("neg").over(all_rows).alias("all_neg"),
    ).where("k >= 0").select(
        (F.col("k") / float(steps)).alias("threshold"), "tp", "fp",
        (F.col("all_neg") - F.col("fp")).alias("tn"), (F.col("all_pos") - F.col("tp")).alias("fn"))
    out = counted.withColumns(rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))
    return out.select("threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "f0_5", "predicted_positive_rate")


def confusion_at(df: DataFrame, y: str, p: str, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts per listed threshold in one pass: every threshold is a set of conditional counts."""
    aggs = []
    for n, t in enumerate(thresholds):
        hit, pos = F.col(p) >= F.lit(float(t)), F.col(y) == 1
        aggs += [F.count_if(hit & pos).alias(f"tp{n}"), F.count_if(hit & ~pos).alias(f"fp{n}"),
                 F.count_if(~hit & ~pos).alias(f"tn{n}"), F.count_if(~hit & pos).alias(f"fn{n}")]
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{c}{n}").alias(c) for c in ("tp", "fp", "tn", "fn")])
        for n, t in enumerate(thresholds)
    ])
    grouped = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    out = grouped.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return out.withColumns(rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def ranking_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Exact ROC-AUC (ties count half) and step-wise average precision; null with a single class."""
    folded = class_counts(df, y, p)
    run = running_totals(folded, "score", ["pos", "neg"])
    c = F.col
    pairs = c("pos") * (c("upto_neg") - c("neg") + 0.5 * c("neg"))
    tp = c("all_pos") - c("upto_pos") + c("pos")
    fp = c("all_neg") - c("upto_neg") + c("neg")
    step = c("pos") * safe_ratio(tp, tp + fp)
    sums = run.agg(F.sum(pairs).alias("pairs"), F.sum(step).alias("steps"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"))
    both = (c("n_pos") > 0) & (c("n_neg") > 0)
    return sums.select(F.when(both, c("pairs") / (c("n_pos") * c("n_neg"))).alias("roc_auc"),
                       F.when(both, c("steps") / c("n_pos")).alias("average_precision"), "n_pos", "n_neg")


def roc_points(df: DataFrame, y: str, p: str) -> DataFrame:
    """One point per distinct score: false and true positive rate and precision at that threshold."""
    run = running_totals(class_counts(df, y, p), "score", ["pos", "neg"])
    tp = F.col("all_pos") - F.col("upto_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("upto_neg") + F.col("neg")
    return run.select("score", safe_ratio(fp, F.col("all_neg")).alias("fpr"), safe_ratio(tp, F.col("all_pos")).alias("tpr"),
                      safe_ratio(tp, tp + fp).alias("precision"))


def probability_bin(p: Column) -> Column:
    """Left-closed bins against explicit edges."""
    clipped = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    out = F.lit(0)
    for edge in BIN_EDGES:
        out = out + (clipped >= F.lit(edge)).cast("int")
    return out


def reliability(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    hit = F.when(F.col(y) > 0.5, 1.0).otherwise(0.0)
    return df.groupBy(*keys, probability_bin(F.col(p)).alias("bin")).agg(
        F.avg(clipped).alias("mean_predicted"), F.avg(hit).alias("mean_observed"), F.count(F.lit(1)).alias("n"))


def calibration_error(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    bins = reliability(df, y, p, keys)
    gap = F.sum(F.col("n") * F.abs(F.col("mean_observed") - F.col("mean_predicted"))) / F.sum("n")
    return (bins.groupBy(*keys) if keys else bins.groupBy()).agg(gap.alias("ece"), F.sum("n").alias("n"))


def brier(y: str, p: str) -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def slice_metrics(df: DataFrame, y: str, p: str, threshold: float, column: Column) -> DataFrame:
    hit, pos = F.col(p) >= F.lit(threshold), F.col(y) == 1
    counts = df.groupBy(F.coalesce(column.cast("string"), F.lit("NULL")).alias("slice")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("pos_rate"),
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    return counts.withColumns({"precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")),
                               "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def confidence_bin(c: Column) -> Column:
    """Right-closed bins (.., 30], (30, 60], (60, 90], (90, ..)."""
    return F.when(c <= 30, "<=30").when(c <= 60, "30-60").when(c <= 90, "60-90").when(c > 90, ">=90")


def worst_slice(slices: DataFrame, total: int | None = None) -> DataFrame:
    """Lowest precision among slices of at least max(5, 5 %) rows."""
    n = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if total is None else F.lit(total)
    sized = slices.withColumn("need", F.greatest(F.lit(5), F.floor(n * 0.05)))
    return sized.where(F.col("n") >= F.col("need")).drop("need").orderBy("precision", F.desc("n"), "slice").limit(1)


def eval_warnings(df: DataFrame, y: str) -> DataFrame:
    n, pos, neg = F.col("n"), F.col("n_pos"), F.col("n_neg")
    notes = F.array_compact(F.array(
        F.when(n < 200, F.lit("small_eval_set")), F.when(neg < 20, F.lit("too_few_negatives")),
        F.when(pos < 20, F.lit("too_few_positives")), F.when((pos == 0) | (neg == 0), F.lit("single_class"))))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg")).withColumn(
        "warnings", F.array_join(notes, ","))


def pick_strong(sweep: DataFrame, target_precision: float) -> DataFrame:
    """Highest recall among thresholds that reach the precision; else the best F0.5."""
    ok = (F.col("precision") >= target_precision) & (F.col("tp") + F.col("fp") > 0)
    ranked = sweep.withColumn("met", ok).withColumn("first", F.when(ok, F.col("recall")).otherwise(F.col("f0_5")))
    return ranked.orderBy(F.desc("met"), F.desc("first"), F.desc("precision"), F.desc("threshold")).limit(1).drop("first")


def pick_downweight(sweep: DataFrame, target_recall: float, min_rate: float) -> DataFrame:
    """Best F1 that reaches the recall and down-weights enough rows; two weaker rules as fall-backs."""
    if not 0.0 <= min_rate < 1.0:
        raise ValueError("min_rate must be in [0, 1)")
    reach = (F.col("recall") >= target_recall) & (F.col("tp") + F.col("fp") > 0)
    useful = F.col("predicted_positive_rate") <= F.lit(1.0 - min_rate + 1e-12)
    rule = F.when(reach & useful, 0).when(reach, 1).otherwise(2)
    return sweep.withColumn("rule", rule).orderBy("rule", F.desc("f1"), F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def nearest_threshold(sweep: DataFrame, t: float) -> DataFrame:
    return sweep.orderBy(F.abs(F.col("threshold") - F.lit(t)), "threshold").limit(1)


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled by their finite range; a constant column becomes 0. The ranges are one row."""
    inf = F.lit(float("inf"))
    ok = lambda c: F.when(F.abs(F.nanvl(F.col(c), inf)) < inf, F.col(c))
    ranges = df.agg(F.struct(*[F.struct(F.min(ok(c)).alias("lo"), F.max(ok(c)).alias("hi")).alias(c) for c in columns]).alias("r"))
    r = ranges.select("r").scalar()
    scaled = {c: F.when(r[c]["hi"] > r[c]["lo"], (F.col(c) - r[c]["lo"]) / (r[c]["hi"] - r[c]["lo"])).otherwise(F.lit(0.0)) for c in columns}
    return df.withColumns(scaled)
