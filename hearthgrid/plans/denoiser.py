"""Training, scoring and evaluation of the noise classifier, and the per-horizon spread models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.operators import metrics

from hearthgrid.plans import training
from hearthgrid.plans.training import split_at_quantile, with_sample_weight
from hearthgrid.session import materialize

# The columns the classifier learns from.
FEATURES = (
    "confidence_norm", "frp", "brightness", "bright_t31", "brightness_minus_t31", "scan", "track", "sin_hour", "cos_hour", "sin_doy", "cos_doy",
    "n_2km_6h", "n_2km_24h", "n_5km_24h", "n_same_cell_24h", "n_same_cell_7d", "dist_nn_24h_km", "seen_same_cell_past_3d",
    "days_with_detection_past_30d_in_cell", "elevation_m", "slope_deg", "aspect_sin", "aspect_cos",
)


def labelled_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of rows labelled POSITIVE or NEGATIVE, with label_numeric."""
    known = labels.where(F.col("label").isin("POSITIVE", "NEGATIVE")).select("id", F.when(F.col("label") == "POSITIVE", 1).otherwise(0).alias("label_numeric"))
    return features.join(known, "id")


def with_missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles plus a 0/1 flag per column that can be missing: trees cannot take NaN."""
    out = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return out.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in columns})


def fit_boosted(train: DataFrame, columns: Sequence[str], label: str, rounds: int = 10, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Boosted trees with balanced weights; gaps are filled with the training median."""
    ready = with_sample_weight(with_missing_flags(train.select(label, *columns), columns), label)
    filled = [f"{c}_filled" for c in columns]
    stages = [
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in columns]], outputCol="features"),
        GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed, maxBins=64),
    ]
    return Pipeline(stages=stages).fit(ready)


def predict(model: PipelineModel, df: DataFrame, columns: Sequence[str], out: str = "p") -> DataFrame:
    scored = model.transform(with_missing_flags(df, columns))
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def train_denoiser(labelled: DataFrame, columns: Sequence[str] = FEATURES, share: float = 0.8, gap_hours: int = 0) -> tuple[PipelineModel, DataFrame]:
    """Fit on the older part; returns the model and the scored newer part."""
    # The trees pass over the data many times, so the split is written once.
    parts = materialize(split_at_quantile(labelled, "acq_time", share, gap_hours=gap_hours), "training-parts")
    model = fit_boosted(parts.where("part = 'train'"), columns, "label_numeric")
    return model, predict(model, parts.where("part = 'eval'"), columns)


def training_report(scored: DataFrame) -> DataFrame:
    """(name, value) rows: model AUC and average precision, and AUC of the single-column baselines."""
    out = metrics.ranking_metrics(scored, "label_numeric", "p").select(F.inline(F.array(
        F.struct(F.lit("roc_auc").alias("name"), F.col("roc_auc").alias("value")), F.struct(F.lit("average_precision").alias("name"), F.col("average_precision").alias("value")))))
    for c in ("confidence_norm", "frp"):
        scaled = metrics.min_max(scored.select("label_numeric", F.col(c).cast("double").alias(c)), [c])
        out = out.unionByName(metrics.ranking_metrics(scaled, "label_numeric", c).select(F.lit(f"roc_auc_{c}").alias("name"), F.col("roc_auc").alias("value")))
    return out


def score_pending(model: PipelineModel, features: DataFrame, threshold: float = 0.5, columns: Sequence[str] = FEATURES) -> DataFrame:
    """denoised_score and is_noise for rows that have no score yet."""
    pending = features.where("denoised_score IS NULL").drop("denoised_score", "is_noise")
    return predict(model, pending, columns, "denoised_score").withColumn("is_noise", F.col("denoised_score") < threshold)


def evaluate(scored: DataFrame, y: str, p: str, target_precision: float = 0.9, target_recall: float = 0.8, min_rate: float = 0.1) -> DataFrame:
    """One row: ranking metrics, Brier, both chosen thresholds, warnings."""
    sweep = metrics.threshold_sweep(scored, y, p)
    row = metrics.ranking_metrics(scored, y, p)
    warn = metrics.eval_warnings(scored, y).select("warnings").scalar()
    return row.withColumns({
        "brier": scored.agg(metrics.brier(y, p).alias("b")).scalar(),
        "strong_threshold": metrics.pick_strong(sweep, target_precision).select("threshold").scalar(),
        "downweight_threshold": metrics.pick_downweight(sweep, target_recall, min_rate).select("threshold").scalar(),
        "warnings": warn,
    })


def report(rows: DataFrame, y: str, p: str, slices: dict[str, Column], time: str = "acq_time", share: float = 0.8, gap_hours: int = 0, top_k: int = 25,
           target_precision: float = 0.9, target_recall: float = 0.8, min_rate: float = 0.1, split_at: str | None = None) -> DataFrame:
    """The full evaluation as (section, name, item, value) rows.

    The split is replayed first (a given time, or the quantile ``share``; rows inside the gap belong to no part), and everything is
    measured on its newer part: ``metrics`` (ranking, Brier score, both chosen thresholds), ``warnings``, ``slices`` at the strong threshold
    and the ``top_k`` most confident errors of either kind. ``split`` counts rows and positives of both parts.
    """
    parted = training.split_at_quantile(rows, time, share, gap_hours=gap_hours) if split_at is None else training.split_at(rows, split_at, gap_hours, time)
    parted = materialize(parted.where("part IS NOT NULL"), "evaluation-parts")
    newer = parted.where("part = 'eval'")

    def long(df: DataFrame, section: str, name: Column, items: Sequence[str]) -> DataFrame:
        listed = F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in items]))
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), listed)

    row = materialize(evaluate(newer, y, p, target_precision, target_recall, min_rate), "evaluation")
    cut = row.select("strong_threshold").first()[0]
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("positives"))
    out = long(counts, "split", F.col("part"), ["n", "positives"])
    out = out.unionByName(long(row, "metrics", F.lit("all"), ["roc_auc", "average_precision", "brier", "strong_threshold", "downweight_threshold"]))
    notes = row.select(F.explode(F.split("warnings", ",")).alias("note")).where("note <> ''")
    out = out.unionByName(notes.select(F.lit("warnings").alias("section"), F.lit("all").alias("name"), F.col("note").alias("item"), F.lit(1.0).alias("value")))
    for title, column in slices.items():
        part = metrics.slice_metrics(newer, y, p, cut, column)
        out = out.unionByName(long(part, "slices", F.concat(F.lit(f"{title}="), F.col("slice")), ["n", "pos_rate", "tp", "fp", "tn", "fn", "precision", "recall"]))
    worst = training.top_errors(newer.select("id", y, p), y, p, top_k)
    return out.unionByName(worst.select(F.lit("errors").alias("section"), F.col("kind").alias("name"), F.col("id").cast("string").alias("item"), F.col(p).cast("double").alias("value")))


def fit_spread_models(cells: DataFrame, horizons: Sequence[int], columns: Sequence[str], label: str = "label") -> dict[int, PipelineModel]:
    """One model per horizon (a handful), each a distributed fit; a horizon with one class gets none."""
    have = {r[0] for r in cells.groupBy("horizon_h").agg(F.count_distinct(label).alias("n")).where("n = 2").collect()}  # one row per horizon
    return {h: fit_boosted(cells.where(F.col("horizon_h") == h), columns, label, rounds=5, depth=3) for h in horizons if h in have}


def learned_forecast(models: dict[int, PipelineModel], cells: DataFrame, horizons: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Probability per cell and horizon; a horizon without a model is zero everywhere."""
    out = None
    for h in horizons:
        part = cells.where(F.col("horizon_h") == h)
        scored = predict(models[h], part, columns) if h in models else part.withColumn("p", F.lit(0.0))
        out = scored if out is None else out.unionByName(scored)
    return out


