"""Labels, features, splits, training and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hearthgrid.catalog.aggregates import AUC_SQL, CONF_BIN_SQL, slice_sql
from hearthgrid.catalog.ansi import add_cte, cte, with_ctes
from hearthgrid.catalog.fields import dem, slopes
from hearthgrid.catalog.projections import COARSE, r6
from hearthgrid.catalog.registry import query
from hearthgrid.catalog.spreading import _BIN as PROBABILITY_BIN_SQL
from hearthgrid.catalog.spreading import HORIZONS, WGRID, World
from hearthgrid.operators.metrics import confidence_bin, ranking_metrics
from hearthgrid.operators.neighbours import neighbour_counts
from hearthgrid.plans import artifacts, calibration, denoiser, hindcast, labels, spread, training
from hearthgrid.plans.features import RADIUS_SPANS, denoiser_features
from hearthgrid.session import materialize, scratch_path

add_cte("labelled", "SELECT d.id, CASE rule WHEN 'Default' THEN 'UNKNOWN' WHEN 'Persistent Cluster' THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label, rule FROM (SELECT d.id, CASE WHEN d.id IN (SELECT id FROM near_industrial) THEN 'Industrial Mask' "
        "WHEN confidence < 30 AND n_5km = 0 THEN 'Low-Conf Singleton' WHEN c.days IS NOT NULL THEN 'Chronic Static' WHEN n_2km > 0 THEN 'Persistent Cluster' ELSE 'Default' END AS rule FROM detections d JOIN around USING (id) "
        "LEFT JOIN chronic c ON CAST(floor(lat / 0.01e0) AS BIGINT) = ci AND CAST(floor(lon / 0.01e0) AS BIGINT) = cj) d", ("near_industrial", "around", "chronic"))


@query("job_label_v1", with_ctes("labelled") + "SELECT id, label, rule FROM labelled")
def label_v1(t):
    return labels.label_detections(t.detections, t.industrial).select("id", "label", "rule")


def _features(t, counts=None):
    return denoiser_features(t.detections, slopes(t, dem(t)).drop("terrain_id"), COARSE, counts)


def _counts(t):
    """What features and labels count around each detection, counted in one go and written for both."""
    return materialize(neighbour_counts(t.detections.select("id", "lat", "lon", "acq_time"), [*RADIUS_SPANS, *labels.rule_spans()]), "learning-counts")


_ROUNDED = ("brightness_minus_t31", "sin_hour", "cos_hour", "sin_doy", "cos_doy", "dist_nn_24h_km", "slope_deg")
FEATURE_SQL = with_ctes("around", "cell_history", "nearest", "cur_terrain") + (
    f"SELECT d.id, coalesce(confidence, 30e0) AS confidence_norm, frp, brightness, bright_t31, round(brightness - bright_t31, 6) AS brightness_minus_t31, scan, track, "
    f"round(sin({2 * math.pi!r}::DOUBLE * (hour(acq_time) + minute(acq_time) / 60e0) / 24e0), 6) AS sin_hour, round(cos({2 * math.pi!r}::DOUBLE * (hour(acq_time) + minute(acq_time) / 60e0) / 24e0), 6) AS cos_hour, "
    f"round(sin({2 * math.pi!r}::DOUBLE * dayofyear(acq_time) / 365.25e0), 6) AS sin_doy, round(cos({2 * math.pi!r}::DOUBLE * dayofyear(acq_time) / 365.25e0), 6) AS cos_doy, "
    "CASE WHEN daynight = 'D' THEN 1 ELSE 0 END AS is_day, n_2km_6h, n_2km_24h, n_5km_6h, n_5km_24h, n_same_cell_24h, n_same_cell_7d, dist_nn_24h_km, seen_same_cell_past_3d, days_with_detection_past_30d_in_cell, "
    "z AS elevation_m, round(slope_deg, 6) AS slope_deg, round(sin(radians(aspect_deg)), 5) AS aspect_sin, round(cos(radians(aspect_deg)), 5) AS aspect_cos "
    "FROM detections d JOIN around USING (id) JOIN cell_history USING (id) JOIN nearest USING (id) "
    "LEFT JOIN cur_terrain t ON t.i = CAST(floor((lat - 40e0) / 0.1e0) AS BIGINT) AND t.j = CAST(floor((lon - 22e0) / 0.1e0) AS BIGINT)")


def _feature_row(rows):
    names = (*denoiser.FEATURES, "is_day", "n_5km_6h")
    shown = {**{c: r6(F.col(c)) for c in _ROUNDED}, **{c: F.round(c, 5) for c in ("aspect_sin", "aspect_cos")}}
    return rows.select("id", *[shown.get(c, F.col(c)).alias(c) for c in names])


@query("job_features", FEATURE_SQL)
def features(t):
    return _feature_row(_features(t))


def _labelled_features(t):
    counts = _counts(t)
    return denoiser.labelled_features(_features(t, counts), labels.label_detections(t.detections, t.industrial, counts=counts))


@query("job_snapshot_split", with_ctes("detections", "labelled", extra={
    "x": "SELECT d.id, CAST(epoch_us(acq_time) AS DOUBLE) AS us, label FROM detections d JOIN labelled USING (id) WHERE label <> 'UNKNOWN'", "c": "SELECT quantile_cont(us, 0.8) AS cut FROM x"}) +
       "SELECT CASE WHEN us < cut THEN 'train' ELSE 'eval' END AS part, count(*) AS n, count_if(label = 'POSITIVE') AS positives FROM x, c GROUP BY 1")
def snapshot_split(t):
    rows = labels.label_detections(t.detections, t.industrial).where("label <> 'UNKNOWN'").join(t.detections.select("id", "acq_time"), "id")
    # Written: the quantile and the split both read the labels.
    rows = materialize(rows.select("acq_time", "label"), "labelled-times")
    return training.split_at_quantile(rows).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "POSITIVE").alias("positives"))


@query("job_split_time_gap", with_ctes("scores") + "SELECT id, CASE WHEN acq_time < TIMESTAMP '2024-01-20 00:00:00' THEN 'train' WHEN acq_time >= TIMESTAMP '2024-01-21 12:00:00' THEN 'eval' END AS part FROM scores")
def split_time_gap(t):
    return training.split_at(t.scores, "2024-01-20 00:00:00", 36).select("id", "part")


@query("job_split_stratified", with_ctes("scores", extra={
    "h": "SELECT id, y, md5(concat(id, '|42')) AS h FROM scores", "f": "SELECT min(h) FILTER (WHERE y = 1) AS p, min(h) FILTER (WHERE y = 0) AS n FROM h",
    "r": "SELECT id, row_number() OVER (ORDER BY CASE WHEN h IN (p, n) THEN 0 ELSE 1 END, h) AS rk FROM h, f"}) + "SELECT id, CASE WHEN rk <= (SELECT CAST(ceil(0.2e0 * count(*)) AS BIGINT) FROM scores) THEN 'eval' ELSE 'train' END AS part FROM r")
def split_stratified(t):
    return training.split_stratified(t.scores.select("id", "y"), "y", "id", 0.2, 42).select("id", "part")


_SLICERS = (("sensor", "sensor"), ("daynight", "daynight"), ("confidence_bin", CONF_BIN_SQL))
_ON_NEWER = lambda text: text.replace("FROM scores", "FROM ev").replace("FROM sweep_raw", "FROM ev_raw")
_EVAL_PARTS = {
    "cut": "SELECT quantile_cont(CAST(epoch_us(acq_time) AS DOUBLE), 0.8) AS cut_us FROM scores", "pt": "SELECT s.*, epoch_us(acq_time) < cut_us AS older, epoch_us(acq_time) >= cut_us + 6 * 3600e6 AS newer FROM scores s, cut",
    "ev": "SELECT * FROM pt WHERE newer", "ev_raw": _ON_NEWER(cte("sweep_raw")), "ev_sweep": _ON_NEWER(cte("sweep")),
    "f": _ON_NEWER(AUC_SQL.split(" AS (", 1)[1].split("), g AS")[0]), "g": AUC_SQL.split("g AS (", 1)[1].rsplit(")", 1)[0],
    "strong": "SELECT threshold AS t FROM ev_sweep ORDER BY precision >= 0.9e0 AND tp + fp > 0 DESC, CASE WHEN precision >= 0.9e0 AND tp + fp > 0 THEN recall ELSE f0_5 END DESC, ev_sweep.precision DESC, threshold DESC LIMIT 1",
    "down": "SELECT threshold AS t FROM ev_sweep ORDER BY CASE WHEN recall >= 0.8e0 AND tp + fp > 0 AND rate <= 0.900000000001e0 THEN 0 WHEN recall >= 0.8e0 AND tp + fp > 0 THEN 1 ELSE 2 END, f1 DESC, recall DESC, precision DESC, threshold LIMIT 1",
    "sl": " UNION ALL ".join(f"SELECT '{n}=' || slice AS name, * FROM ({_ON_NEWER(slice_sql(c, '(SELECT t FROM strong)'))})" for n, c in _SLICERS),
}
_LONG = "SELECT '{0}' AS section, {1} AS name, '{2}' AS item, CAST({2} AS DOUBLE) AS value FROM {3}"
_EVAL_SQL = " UNION ALL ".join([
    *[_LONG.format("split", "part", c, "(SELECT CASE WHEN older THEN 'train' ELSE 'eval' END AS part, count(*) AS n, count_if(y = 1) AS positives FROM pt WHERE older OR newer GROUP BY 1)") for c in ("n", "positives")],
    *[f"SELECT 'metrics', 'all', '{c}', {v}" for c, v in (
        ("roc_auc", "(SELECT sum(pos * (nb - 0.5e0 * neg)) / (max(np) * max(nn)) FROM g)"), ("average_precision", "(SELECT sum(pos * (tp / (tp + fp))) / max(np) FROM g)"),
        ("brier", "(SELECT avg((p - y) * (p - y)) FROM ev)"), ("strong_threshold", "(SELECT t FROM strong)"), ("downweight_threshold", "(SELECT t FROM down)"))],
    "SELECT 'warnings', 'all', 'small_eval_set', 1e0 FROM ev HAVING count(*) < 200", "SELECT 'warnings', 'all', 'too_few_negatives', 1e0 FROM ev HAVING count_if(y = 0) < 20",
    "SELECT 'warnings', 'all', 'too_few_positives', 1e0 FROM ev HAVING count_if(y = 1) < 20",
    *[_LONG.format("slices", "name", c, "sl") for c in ("n", "pos_rate", "tp", "fp", "tn", "fn", "precision", "recall")],
    "SELECT 'errors', 'fp', CAST(id AS VARCHAR), p FROM (SELECT id, p FROM ev WHERE y = 0 ORDER BY p DESC, id LIMIT 25)", "SELECT 'errors', 'fn', CAST(id AS VARCHAR), p FROM (SELECT id, p FROM ev WHERE y = 1 ORDER BY p, id LIMIT 25)"])


@query("job_eval_denoiser", with_ctes("scores", extra=_EVAL_PARTS) + f"SELECT section, name, item, round(value, 6) AS value FROM ({_EVAL_SQL})")
def eval_denoiser(t):
    """Replayed split, metrics, thresholds, warnings, slices and errors of the newer part."""
    slicers = {"sensor": F.col("sensor"), "daynight": F.col("daynight"), "confidence_bin": confidence_bin(F.col("confidence_norm"))}
    return denoiser.report(t.scores, "y", "p", slicers, gap_hours=6).withColumn("value", r6(F.col("value")))


@query("job_train_denoiser")
def train_denoiser(t):
    labelled = materialize(_labelled_features(t), "labelled-features")
    _, scored = denoiser.train_denoiser(labelled)
    return denoiser.training_report(scored)


@query("job_score_denoiser")
def score_denoiser(t):
    """Train, store, load and score the rows without a score; scoring reads the stored model only."""
    counts = _counts(t)
    everything = materialize(_features(t, counts), "features")
    # Written: the quantile, the split and the stored medians all read it.
    known = materialize(denoiser.labelled_features(everything, labels.label_detections(t.detections, t.industrial, counts=counts)), "labelled-features")
    model, _ = denoiser.train_denoiser(known)
    path = artifacts.save_model(model, scratch_path(t.spark, "denoiser"), "denoiser", denoiser.FEATURES, known, "label_numeric", threshold=0.5)
    return artifacts.score_stored(everything, path).select("id", "denoised_score", "is_noise")


SPREAD_COLUMNS = ("fire_t0", "u10", "v10", "t2m", "rh2m", "wind_speed", "elevation_m", "slope_deg", "aspect_sin", "aspect_cos")
IOU_THRESHOLDS = (0.3, 0.5, 0.7)


def _window_cells(t, world):
    """Every cell of the forecast grid for every run and horizon, with its label."""
    observed = hindcast.observed_cells(t.detections, world.runs, HORIZONS, COARSE)
    return hindcast.labelled_cells(world.runs, HORIZONS, world.active, observed, COARSE)


def _with_inputs(world, cells):
    """Weather at the nearest node and terrain of each cell."""
    return hindcast.with_inputs(cells, world.nodes(), world.terrain, COARSE, WGRID)


def _spread_cells(t, world):
    """Training cells: all positives and burning cells, and the documented share of the other negatives."""
    return materialize(_with_inputs(world, hindcast.sample_negatives(_window_cells(t, world))), "spread-cells")


@query("job_train_spread")
def train_spread(t):
    """Ranking metrics and, per threshold, IoU of the validation part for each horizon."""
    parts = training.split_by_time_steps(_spread_cells(t, World(t)), "ref_time", 0.8)
    models = denoiser.fit_spread_models(parts.where("part = 'train'"), HORIZONS, SPREAD_COLUMNS)
    scored = materialize(denoiser.learned_forecast(models, parts.where("part = 'validation'"), HORIZONS, SPREAD_COLUMNS), "spread-scored")
    out = None
    for h in HORIZONS:
        part = ranking_metrics(scored.where(F.col("horizon_h") == h), "label", "p").select(F.lit(h).alias("horizon_h"), "roc_auc", "average_precision", "n_pos", "n_neg")
        out = part if out is None else out.unionByName(part)
    both = lambda p: (F.col("p") >= p) & (F.col("label") == 1)
    either = lambda p: (F.col("p") >= p) | (F.col("label") == 1)
    shares = [F.coalesce(F.try_divide(F.count_if(both(p)), F.count_if(either(p))), F.lit(0.0)).alias(f"iou_{round(100 * p)}") for p in IOU_THRESHOLDS]
    return out.join(scored.groupBy("horizon_h").agg(*shares), "horizon_h", "left")


def stored_spread(t, world):
    """Path of models of the older cases, with a calibration fitted on the newer ones."""
    parts = materialize(training.split_by_time_steps(_spread_cells(t, world), "ref_time", 0.8), "spread-parts")
    older, newer = parts.where("part = 'train'"), parts.where("part = 'validation'")
    models = denoiser.fit_spread_models(older, HORIZONS, SPREAD_COLUMNS)
    scored = denoiser.learned_forecast(models, newer, HORIZONS, SPREAD_COLUMNS).select("horizon_h", F.col("p").alias("y_pred"), F.col("label").cast("double").alias("y_obs"))
    fitted = calibration.fit(materialize(scored.where(F.col("horizon_h").isin(sorted(models))), "spread-scored"))
    return artifacts.save_spread(models, scratch_path(t.spark, "spread-models"), SPREAD_COLUMNS, older, calibrator=fitted)


@query("job_spread_learned")
def spread_learned(t):
    """The calibrated learned forecast of every run's whole window from stored models, zero where the terrain is not valid, summed up per run and horizon."""
    world = World(t)
    forecast = spread.model("learned_v1", {"model_path": stored_spread(t, world)})
    cells = forecast(_with_inputs(world, _window_cells(t, world)), HORIZONS, world.mask)
    return cells.groupBy("run_id", "horizon_h").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("p"), 3).alias("expected"), F.count_if(F.col("p") >= 0.5).alias("likely"),
                                                    F.count_if(F.col("p") == 0).alias("zero"))


def _calibrated(t, method):
    candidates = calibration.candidates(t.hindcast, 0.0)
    parts = materialize(calibration.oldest_cases(candidates, 0.8), "calibration-cells")
    fitted = calibration.fit(parts.where("part = 'train'"), method)
    stored = calibration.load(t.spark, calibration.save(fitted, scratch_path(t.spark, "calibration")))
    scores = calibration.evaluate(calibration.apply(parts.where("part = 'validation'"), stored))
    return scores.select("horizon_h", *[r6(F.col(c)).alias(c) for c in ("brier_raw", "brier_cal")], *[F.round(c, 5).alias(c) for c in ("ece_raw", "ece_cal")], "n")


_SPLIT_SQL = {
    "tm": "SELECT ref_time, row_number() OVER (ORDER BY ref_time) <= floor(count(*) OVER () * 0.8e0) AS older FROM (SELECT DISTINCT ref_time FROM hindcast)",
    "tr": "SELECT h.* FROM hindcast h JOIN tm USING (ref_time) WHERE older", "va": "SELECT h.* FROM hindcast h JOIN tm USING (ref_time) WHERE NOT older",
    "fo": "SELECT horizon_h, y_pred AS x, CAST(count(*) AS DOUBLE) AS n, sum(y_obs) AS s FROM tr GROUP BY 1, 2"}
#: The least-squares non-decreasing fit by its max-min formula over running sums.
_ISOTONIC_SQL = {
    **_SPLIT_SQL, "cu": "SELECT horizon_h, x, row_number() OVER w AS k, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(n) OVER w - n AS bn, sum(s) OVER w - s AS bs FROM fo WINDOW w AS (PARTITION BY horizon_h ORDER BY x)",
    "lo": "SELECT a.horizon_h, a.k AS i, c.k, min((b.cs - a.bs) / (b.cn - a.bn)) AS m FROM cu a JOIN cu c ON c.horizon_h = a.horizon_h AND c.k >= a.k JOIN cu b ON b.horizon_h = a.horizon_h AND b.k >= c.k GROUP BY 1, 2, 3",
    "iso": "SELECT horizon_h, k, max(m) AS y FROM lo GROUP BY 1, 2",
    "cv": "SELECT va.horizon_h, va.y_pred, va.y_obs, iso.y AS y_cal FROM va LEFT JOIN cu ON cu.horizon_h = va.horizon_h AND cu.x = va.y_pred LEFT JOIN iso ON iso.horizon_h = cu.horizon_h AND iso.k = cu.k"}


def _platt_sql(rounds=12):
    """Newton steps for the logistic curve, spelled out."""
    steps = {**_SPLIT_SQL, "w0": "SELECT DISTINCT horizon_h, 0e0 AS a, 0e0 AS b FROM fo"}
    for k in range(rounds):
        steps[f"g{k}"] = (f"SELECT horizon_h, any_value(a) AS a, any_value(b) AS b, sum(s - n * p) AS g0, sum(x * (s - n * p)) AS g1, sum(n * p * (1 - p)) AS h0, sum(x * n * p * (1 - p)) AS h1, sum(x * x * n * p * (1 - p)) AS h2 "
                          f"FROM (SELECT fo.*, a, b, 1e0 / (1e0 + exp(-(a + b * x))) AS p FROM fo JOIN w{k} USING (horizon_h)) GROUP BY 1")
        steps[f"w{k + 1}"] = f"SELECT horizon_h, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM g{k}"
    return {**steps, "cv": f"SELECT va.horizon_h, y_pred, y_obs, 1e0 / (1e0 + exp(-(a + b * y_pred))) AS y_cal FROM va JOIN w{rounds} USING (horizon_h)"}


def _scores_sql(fitted):
    ece = "SELECT horizon_h, sum(n * abs(o - m)) / sum(n) AS ece FROM (SELECT horizon_h, {0} AS b, avg({1}) AS m, avg(y_obs) AS o, count(*) AS n FROM cv GROUP BY 1, 2) GROUP BY 1"
    parts = {"er": ece.format(PROBABILITY_BIN_SQL, "y_pred"), "ec": ece.format(PROBABILITY_BIN_SQL.replace("y_pred", "y_cal"), "y_cal"),
             "b": "SELECT horizon_h, avg((y_pred - y_obs) * (y_pred - y_obs)) AS r, avg((y_cal - y_obs) * (y_cal - y_obs)) AS c, count(*) AS n FROM cv GROUP BY 1"}
    return with_ctes("hindcast", extra={**fitted, **parts}) + "SELECT horizon_h, round(r, 6) AS brier_raw, round(c, 6) AS brier_cal, round(er.ece, 5) AS ece_raw, round(ec.ece, 5) AS ece_cal, n FROM b JOIN er USING (horizon_h) JOIN ec USING (horizon_h)"


@query("job_calibrate_fit", _scores_sql(_ISOTONIC_SQL))
def calibrate_fit(t):
    return _calibrated(t, "isotonic")


@query("job_calibrate_fit_platt", _scores_sql(_platt_sql()))
def calibrate_fit_platt(t):
    return _calibrated(t, "platt")
