"""Fitted models as folders: the Spark ML model, and a metadata row that says how to feed it.

A folder holds ``model`` (Spark ML's own format) and ``metadata`` (one JSON row). Models of several horizons are one
folder each below a common one, next to their calibration. Loading reads nothing else, so a job that scores needs
no training data.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.plans import calibration, denoiser

METADATA = "kind string, columns array<string>, medians map<string, double>, horizon_h int, threshold double, label string, trained_rows long, positive_rows long"
VERSION = 1


@dataclass(frozen=True)
class Fitted:
    """A loaded model with the row that was stored next to it."""

    model: PipelineModel
    kind: str
    columns: tuple[str, ...]
    medians: dict[str, float]
    horizon_h: int | None
    threshold: float | None

    def aligned(self, df: DataFrame) -> DataFrame:
        """``df`` with every column the model reads; those it lacks are null (the model fills its medians in)."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            warnings.warn(f"{self.kind}: no column {', '.join(missing)}; medians of the training rows stand in", stacklevel=2)
        return df.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else df

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """``df`` with the probability of the positive class."""
        return denoiser.predict(self.model, self.aligned(df), self.columns, out).select(*df.columns, out)


def save_model(model: PipelineModel, path: str, kind: str, columns: Sequence[str], train: DataFrame, label: str,
               horizon_h: int | None = None, threshold: float | None = None) -> str:
    """Store a model of ``denoiser.fit_boosted``; refuses a folder that is already there."""
    spark = train.sparkSession
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first()
    medians = model.stages[0].surrogateDF.first().asDict()  # one row
    row = (kind, list(columns), {c: float(v) for c, v in medians.items()}, horizon_h, threshold, label, counts["n"], counts["pos"])
    model.save(f"{path}/model")
    described = spark.createDataFrame([row], METADATA).withColumn("version", F.lit(VERSION))
    described.coalesce(1).write.json(f"{path}/metadata")
    return path


def load_model(spark: SparkSession, path: str, kind: str) -> Fitted:
    """A stored model; one of another kind or of a later format is an error."""
    schema = T._parse_datatype_string(f"{METADATA}, version int")
    row = spark.read.schema(schema).json(f"{path}/metadata").first()
    if row is None or row["kind"] != kind or row["version"] > VERSION:
        raise ValueError(f"{path} holds no {kind} model of format {VERSION}")
    return Fitted(PipelineModel.load(f"{path}/model"), row["kind"], tuple(row["columns"]), dict(row["medians"]), row["horizon_h"], row["threshold"])


def score_stored(features: DataFrame, path: str, threshold: float | None = None) -> DataFrame:
    """denoised_score and is_noise of the rows without a score, from a stored classifier.

    The threshold is the one stored with the model unless the caller names another.
    """
    fitted = load_model(features.sparkSession, path, "denoiser")
    cut = next(x for x in (threshold, fitted.threshold, 0.5) if x is not None)
    pending = features.where("denoised_score IS NULL").drop("denoised_score", "is_noise")
    return fitted.score(pending, "denoised_score").withColumn("is_noise", F.col("denoised_score") < F.lit(float(cut)))


def save_spread(models: dict[int, PipelineModel], path: str, columns: Sequence[str], train: DataFrame, label: str = "label",
                calibrator: calibration.Calibrator | None = None) -> str:
    """One folder per horizon (a handful), and the calibration if there is one."""
    for h, fitted in models.items():
        save_model(fitted, f"{path}/horizon-{h}", "spread", columns, train.where(F.col("horizon_h") == h), label, horizon_h=h)
    train.sparkSession.createDataFrame([(h,) for h in sorted(models)], "horizon_h int").coalesce(1).write.json(f"{path}/horizons")
    if calibrator is not None:
        calibration.save(calibrator, f"{path}/calibration")
    train.sparkSession.createDataFrame([(calibrator is not None,)], "calibrated boolean").coalesce(1).write.json(f"{path}/index")
    return path


def load_spread(spark: SparkSession, path: str) -> tuple[dict[int, Fitted], calibration.Calibrator | None]:
    horizons = [r[0] for r in spark.read.schema("horizon_h int").json(f"{path}/horizons").collect()]  # a handful
    models = {h: load_model(spark, f"{path}/horizon-{h}", "spread") for h in horizons}
    calibrated = spark.read.schema("calibrated boolean").json(f"{path}/index").first()[0]
    return models, calibration.load(spark, f"{path}/calibration") if calibrated else None


def stored_forecast(cells: DataFrame, horizons: Sequence[int], model_path: str, calibrator_path: str | None = None) -> DataFrame:
    """Probability ``p`` per cell and horizon from stored models; a horizon without a model is zero everywhere.

    The calibration stored with the models, or the one under ``calibrator_path``, is applied if there is one.
    """
    spark = cells.sparkSession
    models, calibrator = load_spread(spark, model_path)
    if calibrator_path is not None:
        calibrator = calibration.load(spark, calibrator_path)
    out = None
    for h in horizons:
        part = cells.where(F.col("horizon_h") == h)
        if h not in models:
            warnings.warn(f"no model for the horizon of {h} hours; its forecast is zero", stacklevel=2)
        scored = models[h].score(part) if h in models else part.withColumn("p", F.lit(0.0))
        if h in models and calibrator is not None:
            scored = calibration.apply(scored, calibrator, "p", "cal").withColumn("p", F.col("cal")).drop("cal")
        out = scored if out is None else out.unionByName(scored)
    return out
