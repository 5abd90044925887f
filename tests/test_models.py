"""Stored models, calibration curves and the model registry."""

import random

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions.spread import KernelConfig
from hearthgrid.plans import artifacts, calibration, denoiser, spread
from hearthgrid.session import scratch_path

COLUMNS = ("a", "b")


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        a, b = rng.random(), rng.random()
        y = int(a + 0.3 * rng.random() > 0.6)
        rows.append((k, 6 if k % 2 else 12, a, None if k % 11 == 0 else b, y, None if k % 5 else 0.5, "keep"))
    return spark.createDataFrame(rows, "id long, horizon_h int, a double, b double, label int, denoised_score double, other string").cache()


def test_a_stored_classifier_scores_like_the_trained_one(spark, train):
    model = denoiser.fit_boosted(train, COLUMNS, "label", rounds=3)
    path = artifacts.save_model(model, scratch_path(spark, "model"), "denoiser", COLUMNS, train, "label", threshold=0.4)
    fitted = artifacts.load_model(spark, path, "denoiser")
    assert fitted.columns == COLUMNS and fitted.threshold == 0.4 and 0.4 < fitted.medians["a"] < 0.6
    fresh = {r["id"]: r["denoised_score"] for r in denoiser.predict(model, train.where("denoised_score IS NULL").drop("denoised_score"), COLUMNS, "denoised_score").collect()}
    scored = artifacts.score_stored(train, path)
    rows = {r["id"]: r for r in scored.collect()}
    assert {k: r["denoised_score"] for k, r in rows.items()} == fresh and len(fresh) == 480
    assert all(r["is_noise"] == (r["denoised_score"] < 0.4) and r["other"] == "keep" for r in rows.values())
    assert any(r["is_noise"] for r in artifacts.score_stored(train, path, threshold=1.1).collect())
    with pytest.warns(UserWarning, match="no column b"):
        lacking = {r["id"]: r["p"] for r in fitted.score(train.drop("b")).collect()}
    filled = {r["id"]: r["p"] for r in fitted.score(train.withColumn("b", F.lit(None).cast("double"))).collect()}
    assert lacking == filled
    with pytest.raises(ValueError):
        artifacts.load_model(spark, path, "spread")
    with pytest.raises(Exception, match="exists"):
        artifacts.save_model(model, path, "denoiser", COLUMNS, train, "label")


@pytest.mark.parametrize("method", ["none", "isotonic", "platt"])
def test_stored_spread_models_forecast_like_the_fitted_ones(spark, train, method):
    cells = train.withColumns({"run_id": F.lit(1), "i": F.col("id") % 30, "j": F.floor(F.col("id") / 30)}).drop("denoised_score")
    models = denoiser.fit_spread_models(cells.where("horizon_h = 6"), (6, 12), COLUMNS)
    assert set(models) == {6}
    fresh = denoiser.learned_forecast(models, cells, (6, 12), COLUMNS)
    fitted = None if method == "none" else calibration.fit(fresh.where("horizon_h = 6").select("horizon_h", F.col("p").alias("y_pred"), F.col("label").cast("double").alias("y_obs")), method)
    path = artifacts.save_spread(models, scratch_path(spark, "spread"), COLUMNS, cells, calibrator=fitted)
    mask = cells.select("i", "j", (F.col("i") > 3).alias("valid")).distinct()
    with pytest.warns(UserWarning):
        run = spread.model("learned_v1", {"model_path": path, "colour": "red"})
        got = {r["id"]: r["p"] for r in run(cells, (6, 12), mask).collect()}
    want = fresh if fitted is None else calibration.apply(fresh, fitted, "p", "cal").withColumn("p", F.when(F.col("horizon_h") == 6, F.col("cal")).otherwise(F.col("p")))
    want = {r["id"]: (r["p"] if r["i"] > 3 else 0.0) for r in want.collect()}
    assert got == want and any(got.values())
    assert all(got[r["id"]] == 0.0 for r in cells.where("horizon_h = 12").collect())


def test_registry_drops_unknown_parameters_with_a_warning():
    with pytest.warns(UserWarning, match="heuristic_v0: unknown parameters left out: colour, shape"):
        run = spread.model("heuristic_v0", {"decay_km": 3.0, "shape": 1, "colour": 2})
    assert run.keywords == {"cfg": KernelConfig(decay_km=3.0)}
    with pytest.raises(ValueError, match="heuristic_v0, learned_v1"):
        spread.model("nope")


def plain_isotonic(points):
    """Non-decreasing fit by the max-min formula: x -> value."""
    xs = sorted({x for x, _ in points})
    n = {x: [y for a, y in points if a == x] for x in xs}
    mean = lambda i, j: sum(sum(n[x]) for x in xs[i:j + 1]) / sum(len(n[x]) for x in xs[i:j + 1])
    return {x: max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k, x in enumerate(xs)}


@pytest.mark.parametrize("parts", [1, 5, 13])
def test_isotonic_fit_equals_the_max_min_formula(spark, parts):
    rng = random.Random(parts)
    by = {6: [(rng.randrange(40) / 40, float(rng.random() < 0.5)) for _ in range(300)], 12: [(k / 30, float(k % 7 > 2)) for k in range(30)],
          24: [(k / 20, 1.0 - k / 20) for k in range(20)], 48: [(0.3, 1.0), (0.3, 0.0), (0.3, 1.0)], 72: [(k / 9, k / 9) for k in range(9)]}
    rows = [(h, x, y) for h, points in by.items() for x, y in points] + [(6, None, 1.0), (6, 0.5, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        knots = calibration.isotonic_knots(spark.createDataFrame(rows, "horizon_h int, y_pred double, y_obs double"))
        got = {(r["horizon_h"], r["y_pred"]): r["y_cal"] for r in calibration.apply_knots(spark.createDataFrame(rows, "horizon_h int, y_pred double, y_obs double"), knots).collect()}
        listed = knots.orderBy("horizon_h", "x").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for h, points in by.items():
        for x, y in plain_isotonic(points).items():
            assert got[h, x] == pytest.approx(y, abs=1e-12)
        own = [r["y"] for r in listed if r["horizon_h"] == h]
        assert own == sorted(own)
    assert got[6, None] is None


def test_curves_are_linear_between_knots_and_flat_outside(spark):
    knots = spark.createDataFrame([(6, 0.2, 0.1), (6, 0.4, 0.5), (6, 0.40001, 0.6), (6, 0.9, 2.0)], "horizon_h int, x double, y double")
    cells = spark.createDataFrame([(6, x) for x in (0.0, 0.2, 0.3, 0.4, 0.400005, 0.9, 1.0, -1.0, 7.0)] + [(12, 0.3), (12, 1.5), (6, None)], "horizon_h int, y_pred double")
    got = {(r["horizon_h"], r["y_pred"]): r["y_cal"] for r in calibration.apply_knots(cells, knots).collect()}
    want = {(6, 0.0): 0.1, (6, 0.2): 0.1, (6, 0.3): 0.3, (6, 0.4): 0.5, (6, 0.400005): 0.55, (6, 0.9): 1.0, (6, 1.0): 1.0, (6, -1.0): 0.1, (6, 7.0): 1.0, (12, 0.3): 0.3, (12, 1.5): 1.0}
    assert all(got[k] == pytest.approx(v) for k, v in want.items()) and got[6, None] is None and len(got) == 12
    assert calibration.apply_knots(cells, knots.limit(0)).where("y_cal <> least(greatest(y_pred, 0), 1)").count() == 0
