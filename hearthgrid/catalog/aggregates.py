"""Heatmaps, ingest accounting, classifier metrics, table changes, windows and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgrid.catalog.ansi import add_cte, with_ctes
from hearthgrid.catalog.projections import ACCEPTED_SQL, BUCKET_SQL, CELL_SQL, COARSE, FINE, PARSED_SQL, r6
from hearthgrid.catalog.registry import query
from hearthgrid.functions import features
from hearthgrid.functions.parse import accepted, parse_feed
from hearthgrid.operators import heatmap, metrics, ordered, runs, tables
from hearthgrid.plans import ingest

D = with_ctes("detections")
S = with_ctes("scores")
add_cte("fine", f"SELECT *, {CELL_SQL.format(c='0.01e0')} FROM detections", ("detections",))
add_cte("coarse", f"SELECT *, {CELL_SQL.format(c='0.1e0')} FROM detections", ("detections",))


@query("agg_heatmap_count", with_ctes("fine") + "SELECT i, j, count(*) AS value FROM fine GROUP BY 1, 2")
def heat_count(t):
    return heatmap.heatmap(t.detections, FINE, "count")


@query("agg_heatmap_presence", with_ctes("fine") + "SELECT i, j, 1 AS value FROM fine GROUP BY 1, 2")
def heat_presence(t):
    return heatmap.heatmap(t.detections, FINE, "presence")


@query("agg_heatmap_sum", with_ctes("fine") + "SELECT i, j, round(sum(frp), 4) AS value FROM fine GROUP BY 1, 2")
def heat_sum(t):
    return heatmap.heatmap(t.detections, FINE, "sum", F.col("frp")).withColumn("value", F.round("value", 4))


@query("agg_heatmap_max", with_ctes("fine") + "SELECT i, j, max(frp) AS value FROM fine GROUP BY 1, 2")
def heat_max(t):
    return heatmap.heatmap(t.detections, FINE, "max", F.col("frp"))


@query("agg_heatmap_window", with_ctes("coarse") + "SELECT i - 30 AS i_local, j - 30 AS j_local, i, j, count(*) AS value FROM coarse WHERE i >= 30 AND i < 170 AND j >= 30 AND j < 160 "
       "AND is_noise IS NOT TRUE AND acq_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00' GROUP BY i, j")
def heat_window(t):
    from hearthgrid.operators.filters import in_time, not_true
    d = t.detections.where(in_time("2024-01-05 06:00:00", "2024-01-20 18:30:00") & not_true("is_noise"))
    return heatmap.window_heatmap(d, COARSE, COARSE.window(25.0, 43.0, 38.0, 57.0))


@query("agg_heatmap_weighted", with_ctes("fine") + "SELECT i, j, round(sum(coalesce(denoised_score, 1e0)), 4) AS value FROM fine GROUP BY 1, 2")
def heat_weighted(t):
    return heatmap.heatmap(t.detections, FINE, "sum", heatmap.noise_weight()).withColumn("value", F.round("value", 4))


@query("agg_heatmap_dense", with_ctes("coarse", extra={"g": "SELECT a.i, b.j FROM (SELECT unnest(range(200)) AS i) a, (SELECT unnest(range(200)) AS j) b",
                                                       "h": "SELECT i, j, count(*) AS value FROM coarse GROUP BY 1, 2"}) +
       "SELECT i, j, coalesce(value, 0) AS value FROM g LEFT JOIN h USING (i, j)")
def heat_dense(t):
    return heatmap.dense(heatmap.heatmap(t.detections, COARSE, "count"), COARSE)


@query("agg_region_latest_grid", with_ctes("terrain_meta", extra={
    "f": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY created_at DESC) AS rn FROM terrain_meta WHERE has_features) WHERE rn = 1",
    "d": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY created_at DESC) AS rn FROM terrain_meta) WHERE rn = 1"}) +
       "SELECT d.region, f.region IS NOT NULL AS from_features, coalesce(f.cell, d.cell) AS cell, coalesce(f.origin_lat, d.origin_lat) AS origin_lat, "
       "coalesce(f.origin_lon, d.origin_lon) AS origin_lon, coalesce(f.n_lat, d.n_lat) AS n_lat, coalesce(f.n_lon, d.n_lon) AS n_lon FROM d LEFT JOIN f USING (region)")
def region_latest_grid(t):
    return heatmap.region_grid(t.terrain_meta.where("has_features"), t.terrain_meta)


CHRONIC = "SELECT ci, cj, days FROM (SELECT CAST(floor(lat / 0.01e0) AS BIGINT) AS ci, CAST(floor(lon / 0.01e0) AS BIGINT) AS cj, count(DISTINCT CAST(acq_time AS DATE)) AS days FROM detections GROUP BY 1, 2) WHERE days >= 20"
add_cte("chronic", CHRONIC, ("detections",))


@query("agg_chronic", with_ctes("chronic") + "SELECT * FROM chronic")
def chronic(t):
    return heatmap.chronic_cells(t.detections, 0.01, 20)


@query("join_chronic_cell", with_ctes("chronic") + "SELECT id FROM detections d JOIN chronic c ON CAST(floor(lat / 0.01e0) AS BIGINT) = ci AND CAST(floor(lon / 0.01e0) AS BIGINT) = cj")
def chronic_cell(t):
    from hearthgrid.plans.labels import in_chronic_cell
    return in_chronic_cell(t.detections.select("id", "lat", "lon", "acq_time"), 0.01, 20).where("chronic").select("id")


BUCKET6 = "date_trunc('hour', acq_time) - INTERVAL '1' HOUR * (hour(acq_time) % 6)"


@query("agg_time_bucket", D + f"SELECT {BUCKET6} AS ref_time, count(*) AS detections FROM detections GROUP BY 1 HAVING count(*) >= 5")
def time_bucket(t):
    return heatmap.busy_times(t.detections, 6, 5)


_OK = "reject_reason IS NULL"
_CONF = "CASE WHEN confidence_raw BETWEEN 0 AND 100 THEN confidence_raw END"


@query("agg_validation_summary", with_ctes("raw_rows", extra={"parsed": PARSED_SQL}) +
       "SELECT 'total' AS metric, '' AS item, count(*) AS n FROM parsed UNION ALL SELECT 'parsed', '', count(*) FROM parsed WHERE reject_reason IS NULL "
       "UNION ALL SELECT 'skipped', reject_reason, count(*) FROM parsed WHERE reject_reason IS NOT NULL GROUP BY reject_reason "
       f"UNION ALL SELECT 'confidence', 'missing', count(*) FROM parsed WHERE {_OK} AND confidence_raw IS NULL "
       f"UNION ALL SELECT 'confidence', 'out_of_range', count(*) FROM parsed WHERE {_OK} AND NOT confidence_raw BETWEEN 0 AND 100 "
       f"UNION ALL SELECT 'brightness', 'missing', count(*) FROM parsed WHERE {_OK} AND brightness_raw IS NULL "
       f"UNION ALL SELECT 'brightness', 'out_of_range', count(*) FROM parsed WHERE {_OK} AND NOT brightness_raw BETWEEN 200 AND 500 "
       f"UNION ALL SELECT 'sensor', coalesce(sensor, 'unknown'), count(*) FROM parsed WHERE {_OK} GROUP BY 2 "
       f"UNION ALL SELECT 'bucket', {BUCKET_SQL.format(c=_CONF)}, count(*) FROM parsed WHERE {_OK} GROUP BY 2")
def validation_summary(t):
    return ingest.validation_summary(t.raw_rows)


# Two overlapping pulls against a table that already holds the first days.
PULLS = {"parsed": PARSED_SQL, "acc": f"SELECT * FROM ({ACCEPTED_SQL.replace('SELECT row_id, source', 'SELECT row_id, ts, source', 1)})",
         "target": "SELECT * FROM acc WHERE ts < TIMESTAMP '2024-01-05 00:00:00'",
         "pulls": "SELECT * FROM acc WHERE ts < TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT * FROM acc WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'",
         "fresh": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, dedupe_hash ORDER BY acq_time, row_id) AS rn FROM pulls) p WHERE rn = 1 "
                  "AND NOT EXISTS (SELECT 1 FROM target t WHERE t.source = p.source AND t.dedupe_hash = p.dedupe_hash)"}


def _pulls(t):
    raw = t.raw_rows
    target = accepted(parse_feed(raw.where("ts < TIMESTAMP_NTZ '2024-01-05 00:00:00'")))
    incoming = raw.where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'").unionByName(raw.where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return incoming, target


@query("agg_ingest_metrics", with_ctes("raw_rows", extra={
    **PULLS, "f": "SELECT source, count(*) AS fetched FROM (SELECT source FROM raw_rows WHERE ts < TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT source FROM raw_rows WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') GROUP BY 1",
    "p": "SELECT source, count(*) AS parsed FROM pulls GROUP BY 1", "n": "SELECT source, count(*) AS inserted FROM fresh GROUP BY 1"}) +
       "SELECT source, fetched, parsed, inserted, parsed - inserted AS duplicates FROM f JOIN p USING (source) JOIN n USING (source)")
def ingest_metrics(t):
    return ingest.ingest_metrics(*_pulls(t))


@query("set_insert_ignore", with_ctes("raw_rows", extra=PULLS) + "SELECT row_id, source, dedupe_hash FROM fresh")
def insert_ignore(t):
    return ingest.new_detections(*_pulls(t)).select("row_id", "source", "dedupe_hash")


@query("win_dedupe", with_ctes("raw_rows", extra=PULLS) + "SELECT row_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, dedupe_hash ORDER BY acq_time, row_id) AS rn FROM pulls) WHERE rn = 1")
def dedupe(t):
    incoming, _ = _pulls(t)
    return tables.first_per_key(accepted(parse_feed(incoming)), ingest.KEYS, ["acq_time", "row_id"]).select("row_id", "source")


@query("agg_score_summary", D + "SELECT count(denoised_score) AS n, round(avg(denoised_score), 6) AS mean, round(quantile_cont(denoised_score, 0.5), 6) AS median, min(denoised_score) AS low, max(denoised_score) AS high, "
       "count_if(is_noise) AS noise, round(100e0 * count_if(is_noise) / count(denoised_score), 4) AS noise_pct FROM detections")
def score_summary(t):
    from hearthgrid.plans.training import score_summary as summary
    s = summary(t.detections, "denoised_score", "is_noise")
    return s.select("n", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"), "low", "high", "noise", F.round("noise_pct", 4).alias("noise_pct"))


@query("agg_threshold_sweep", with_ctes("scores", extra={"th": "SELECT k / 100e0 AS threshold FROM (SELECT unnest(range(101)) AS k)",
    "c": "SELECT threshold, count_if(p >= threshold AND y = 1) AS tp, count_if(p >= threshold AND y = 0) AS fp, count_if(p < threshold AND y = 0) AS tn, count_if(p < threshold AND y = 1) AS fn FROM scores, th GROUP BY threshold",
    "pr": "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall FROM c"}) +
       "SELECT threshold, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END, 6) AS f1, "
       "round(CASE WHEN 0.25e0 * precision + recall > 0 THEN 1.25e0 * precision * recall / (0.25e0 * precision + recall) ELSE 0e0 END, 6) AS f0_5, round((tp + fp) / (tp + fp + tn + fn), 6) AS predicted_positive_rate FROM pr")
def sweep(t):
    s = metrics.threshold_sweep(t.scores, "y", "p")
    return s.select("threshold", "tp", "fp", "tn", "fn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "f0_5", "predicted_positive_rate")])


add_cte("sweep_raw", "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall, (tp + fp) / (tp + fp + tn + fn) AS rate FROM ("
        "SELECT threshold, count_if(p >= threshold AND y = 1) AS tp, count_if(p >= threshold AND y = 0) AS fp, count_if(p < threshold AND y = 0) AS tn, count_if(p < threshold AND y = 1) AS fn "
        "FROM scores, (SELECT k / 100e0 AS threshold FROM (SELECT unnest(range(101)) AS k)) th GROUP BY threshold)", ("scores",))
add_cte("sweep", "SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1, "
        "CASE WHEN 0.25e0 * precision + recall > 0 THEN 1.25e0 * precision * recall / (0.25e0 * precision + recall) ELSE 0e0 END AS f0_5 FROM sweep_raw", ("sweep_raw",))


@query("top_pick_strong", with_ctes("sweep") + "SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep ORDER BY precision >= 0.9e0 AND tp + fp > 0 DESC, CASE WHEN precision >= 0.9e0 AND tp + fp > 0 THEN recall ELSE f0_5 END DESC, sweep.precision DESC, threshold DESC LIMIT 1")
def pick_strong(t):
    return metrics.pick_strong(metrics.threshold_sweep(t.scores, "y", "p"), 0.9).select("threshold", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("top_pick_downweight", with_ctes("sweep") + "SELECT threshold, round(f1, 6) AS f1, CASE WHEN recall >= 0.8e0 AND tp + fp > 0 AND rate <= 0.600000000001e0 THEN 0 WHEN recall >= 0.8e0 AND tp + fp > 0 THEN 1 ELSE 2 END AS rule "
       "FROM sweep ORDER BY rule, sweep.f1 DESC, recall DESC, precision DESC, threshold LIMIT 1")
def pick_downweight(t):
    return metrics.pick_downweight(metrics.threshold_sweep(t.scores, "y", "p"), 0.8, 0.4).select("threshold", r6(F.col("f1")).alias("f1"), "rule")


@query("top_nearest_threshold", with_ctes("sweep") + "SELECT threshold, tp, fp FROM sweep ORDER BY abs(threshold - 0.333e0), threshold LIMIT 1")
def nearest(t):
    return metrics.nearest_threshold(metrics.threshold_sweep(t.scores, "y", "p"), 0.333).select("threshold", "tp", "fp")


@query("agg_confusion", S + " UNION ALL ".join(
    f"SELECT {x}e0 AS threshold, count_if(p >= {x}e0 AND y = 1) AS tp, count_if(p >= {x}e0 AND y = 0) AS fp, count_if(p < {x}e0 AND y = 0) AS tn, count_if(p < {x}e0 AND y = 1) AS fn, "
    f"round(count_if(p >= {x}e0 AND y = 1) / count_if(p >= {x}e0 OR y = 1), 6) AS iou FROM scores" for x in (0.2, 0.5, 0.8)))
def confusion(t):
    return metrics.confusion_at(t.scores, "y", "p", [0.2, 0.5, 0.8]).select("threshold", "tp", "fp", "tn", "fn", r6(F.col("iou")).alias("iou"))


AUC_SQL = ("f AS (SELECT p, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scores GROUP BY p), "
           "g AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(neg) OVER (ORDER BY p) AS nb, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM f) ")


@query("agg_roc_pr_auc", S.rstrip() + ", " + AUC_SQL + "SELECT round(sum(pos * (nb - 0.5e0 * neg)) / (max(np) * max(nn)), 6) AS roc_auc, round(sum(pos * (tp / (tp + fp))) / max(np), 6) AS average_precision, CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg FROM g")
def auc(t):
    return metrics.ranking_metrics(t.scores, "y", "p").select(r6(F.col("roc_auc")).alias("roc_auc"), r6(F.col("average_precision")).alias("average_precision"), "n_pos", "n_neg")


@query("win_auc_rank", with_ctes("scores") + "SELECT id, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS avg_rank FROM scores")
def auc_rank(t):
    folded = t.scores.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered.running_totals(folded, "p", ["n"]).select("p", (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias("avg_rank"))
    return t.scores.join(ranked, "p").select("id", "avg_rank")


@query("agg_brier", S + "SELECT round(avg((p - y) * (p - y)), 8) AS brier FROM scores")
def brier(t):
    return t.scores.agg(F.round(metrics.brier("y", "p"), 8).alias("brier"))


BIN_SQL = "(" + " + ".join(f"CASE WHEN {{p}} >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in metrics.BIN_EDGES) + ")"


@query("agg_ece", S + f"SELECT round(sum(n * abs(o - m)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {BIN_SQL.format(p='p')} AS b, avg(p) AS m, avg(y) AS o, count(*) AS n FROM scores GROUP BY 1)")
def ece(t):
    return metrics.calibration_error(t.scores, "y", "p").select(r6(F.col("ece")).alias("ece"), "n")


@query("agg_reliability", with_ctes("hindcast") + f"SELECT horizon_h, CAST({BIN_SQL.format(p='y_pred')} AS INTEGER) AS bin, round(avg(y_pred), 6) AS mean_predicted, round(avg(y_obs), 6) AS mean_observed, count(*) AS n FROM hindcast GROUP BY 1, 2")
def reliability(t):
    got = metrics.reliability(t.hindcast, "y_obs", "y_pred", ["horizon_h"])
    return got.select("horizon_h", "bin", r6(F.col("mean_predicted")).alias("mean_predicted"), r6(F.col("mean_observed")).alias("mean_observed"), "n")


def slice_sql(col: str, t: str) -> str:
    return (f"SELECT slice, n, round(pos_rate, 6) AS pos_rate, tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END, 6) AS recall FROM ("
            f"SELECT coalesce({col}, 'NULL') AS slice, count(*) AS n, avg(y) AS pos_rate, count_if(p >= {t} AND y = 1) AS tp, count_if(p >= {t} AND y = 0) AS fp, count_if(p < {t} AND y = 0) AS tn, count_if(p < {t} AND y = 1) AS fn FROM scores GROUP BY 1)")


CONF_BIN_SQL = "CASE WHEN confidence_norm <= 30 THEN '<=30' WHEN confidence_norm <= 60 THEN '30-60' WHEN confidence_norm <= 90 THEN '60-90' ELSE '>=90' END"


def _rounded_slices(df):
    return df.select("slice", "n", r6(F.col("pos_rate")).alias("pos_rate"), "tp", "fp", "tn", "fn", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("agg_slice_metrics", S + " UNION ALL ".join(f"SELECT '{n}' AS slicer, * FROM ({slice_sql(c, '0.6e0')})" for n, c in (("sensor", "sensor"), ("daynight", "daynight"), ("confidence_bin", CONF_BIN_SQL))))
def slices(t):
    out = None
    for name, col in (("sensor", F.col("sensor")), ("daynight", F.col("daynight")), ("confidence_bin", metrics.confidence_bin(F.col("confidence_norm")))):
        part = _rounded_slices(metrics.slice_metrics(t.scores, "y", "p", 0.6, col)).select(F.lit(name).alias("slicer"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("top_worst_slice", S + f"SELECT slice, n, precision FROM ({slice_sql('sensor', '0.6e0')}) WHERE n >= (SELECT greatest(5, floor(0.05e0 * count(*))) FROM scores) ORDER BY precision, n DESC, slice LIMIT 1")
def worst(t):
    return metrics.worst_slice(metrics.slice_metrics(t.scores, "y", "p", 0.6, F.col("sensor"))).select("slice", "n", r6(F.col("precision")).alias("precision"))


@query("agg_eval_warnings", S + "SELECT count(*) AS n, count_if(y = 1) AS n_pos, count_if(y = 0) AS n_neg, CASE WHEN count(*) < 200 THEN 'small_eval_set' ELSE '' END AS warnings FROM scores")
def warnings(t):
    return metrics.eval_warnings(t.scores, "y")


_SCALED = "SELECT y, (confidence_norm - lo) / (hi - lo) AS s, (frp - flo) / (fhi - flo) AS f FROM scores, (SELECT min(confidence_norm) AS lo, max(confidence_norm) AS hi, min(frp) AS flo, max(frp) AS fhi FROM scores)"


@query("agg_baselines", with_ctes("scores", extra={"z": _SCALED}) + " UNION ALL ".join(
    f"SELECT '{n}' AS baseline, {x}e0 AS threshold, count_if({c} >= {x}e0 AND y = 1) AS tp, count_if({c} >= {x}e0 AND y = 0) AS fp, count_if({c} < {x}e0 AND y = 0) AS tn, count_if({c} < {x}e0 AND y = 1) AS fn FROM z"
    for n, c in (("confidence_norm", "s"), ("frp", "f")) for x in (0.25, 0.5)))
def baselines(t):
    from hearthgrid.plans.training import baseline_metrics
    return baseline_metrics(t.scores, "y", ["confidence_norm", "frp"], [0.25, 0.5]).select("baseline", "threshold", "tp", "fp", "tn", "fn")


@query("agg_pos_rate", S + "SELECT y, count(*) AS n, round((SELECT count(*) FROM scores) / (2e0 * count(*)), 6) AS weight, round((SELECT avg(y) FROM scores), 6) AS pos_rate FROM scores GROUP BY y")
def pos_rate(t):
    from hearthgrid.plans.training import class_weights
    return class_weights(t.scores, "y").select("y", "n", r6(F.col("weight")).alias("weight"), r6(F.col("pos_rate")).alias("pos_rate"))


@query("top_errors", S + "(SELECT 'fp' AS kind, id, p FROM scores WHERE y = 0 ORDER BY p DESC, id LIMIT 25) UNION ALL (SELECT 'fn' AS kind, id, p FROM scores WHERE y = 1 ORDER BY p, id LIMIT 25)")
def errors(t):
    from hearthgrid.plans.training import top_errors
    return top_errors(t.scores, "y", "p", 25).select("kind", "id", "p")


@query("top_detections", D + "SELECT id, acq_time FROM detections ORDER BY acq_time DESC, id DESC LIMIT 500")
def top_detections(t):
    return t.detections.orderBy(F.desc("acq_time"), F.desc("id")).limit(500).select("id", "acq_time")


@query("top_aois", with_ctes("aois") + "SELECT aoi_id, name, created_at FROM aois ORDER BY created_at DESC, aoi_id DESC LIMIT 200 OFFSET 20")
def top_aois(t):
    return t.aois.orderBy(F.desc("created_at"), F.desc("aoi_id")).offset(20).limit(200).select("aoi_id", "name", "created_at")


@query("top_run_assets", with_ctes("hindcast") + "SELECT case_id, horizon_h, threshold FROM (SELECT DISTINCT case_id, horizon_h FROM hindcast), (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS threshold) WHERE case_id = (SELECT max(case_id) FROM hindcast) ORDER BY horizon_h, threshold")
def run_assets(t):
    newest = t.hindcast.agg(F.max("case_id").alias("c")).scalar()
    assets = t.hindcast.where(F.col("case_id") == newest).select("case_id", "horizon_h").distinct()
    return assets.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7)]))).orderBy("horizon_h", "threshold")


@query("win_latest_region", with_ctes("terrain_meta") + "SELECT region, terrain_id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY created_at DESC, terrain_id DESC) AS rn FROM terrain_meta) WHERE rn = 1")
def latest_region(t):
    return runs.newest_per(t.terrain_meta.select("region", "terrain_id", "created_at"), ["region"], ["created_at", "terrain_id"]).select("region", "terrain_id")


add_cte("latest_forecast", "SELECT region, run_id, ref_time FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ref_time DESC, created_at DESC, run_id DESC) AS rn FROM forecast_runs WHERE status = 'completed' "
        "AND min_lon <= 36 AND max_lon >= 25 AND min_lat <= 55 AND max_lat >= 43) WHERE rn = 1", ("forecast_runs",))


@query("win_latest_forecast", with_ctes("latest_forecast") + "SELECT * FROM latest_forecast")
def latest_forecast(t):
    hit = (F.col("min_lon") <= 36) & (F.col("max_lon") >= 25) & (F.col("min_lat") <= 55) & (F.col("max_lat") >= 43)
    return runs.newest_per(t.forecast_runs.where(hit & (F.col("status") == "completed")).select("region", "run_id", "ref_time", "created_at"),
                           ["region"], ["ref_time", "created_at", "run_id"]).select("region", "run_id", "ref_time")


@query("join_latest_run_bbox", with_ctes("weather_runs", "aois") + "SELECT aoi_id, run_id FROM (SELECT aoi_id, run_id, row_number() OVER (PARTITION BY aoi_id ORDER BY run_time DESC, r.created_at DESC, run_id DESC) AS rn "
       "FROM aois a JOIN weather_runs r ON r.status = 'completed' AND run_time <= TIMESTAMP '2024-01-12 05:00:00' AND coalesce(r.min_lon, -180) <= a.min_lon AND coalesce(r.max_lon, 180) >= a.max_lon "
       "AND coalesce(r.min_lat, -90) <= a.min_lat AND coalesce(r.max_lat, 90) >= a.max_lat) WHERE rn = 1")
def latest_run_bbox(t):
    from hearthgrid.operators.runs import latest_run_for_boxes
    boxes = t.aois.select(F.col("aoi_id").alias("id"), "min_lon", "min_lat", "max_lon", "max_lat").withColumn("at", F.lit("2024-01-12 05:00:00").cast("timestamp_ntz"))
    return latest_run_for_boxes(boxes, t.weather_runs).select(F.col("id").alias("aoi_id"), "run_id")


TILE_TIMES = "SELECT DISTINCT CAST(floor((lat - 40) / 2) AS BIGINT) AS ti, CAST(floor((lon - 22) / 2) AS BIGINT) AS tj, " + BUCKET6 + " AS ref_time FROM detections"


@query("win_sessionize", with_ctes("detections", extra={"r": TILE_TIMES, "g": "SELECT *, CASE WHEN ref_time - lag(ref_time) OVER (PARTITION BY ti, tj ORDER BY ref_time) <= INTERVAL '9' HOUR THEN 0 ELSE 1 END AS gap FROM r",
                                                        "e": "SELECT *, sum(gap) OVER (PARTITION BY ti, tj ORDER BY ref_time) AS event FROM g"}) +
       "SELECT ti, tj, event_start, steps FROM (SELECT ti, tj, event, min(ref_time) AS event_start, count(*) AS steps FROM e GROUP BY 1, 2, 3) WHERE steps >= 2")
def sessionize(t):
    from hearthgrid.plans.hindcast import group_events
    times = t.detections.select(F.floor((F.col("lat") - 40) / 2).alias("ti"), F.floor((F.col("lon") - 22) / 2).alias("tj"), heatmap.time_bucket(F.col("acq_time"), 6).alias("ref_time")).distinct()
    return group_events(times, ["ti", "tj"], 6, 2).groupBy("ti", "tj", "event_start").agg(F.count(F.lit(1)).alias("steps"))


CELL_HISTORY = ("SELECT a.id, count_if(dt BETWEEN -86400e6 AND 0) - 1 AS n_same_cell_24h, count_if(dt BETWEEN -604800e6 AND 0) - 1 AS n_same_cell_7d, "
                "CAST(count_if(dt >= -259200e6 AND dt < 0) > 0 AS INTEGER) AS seen_same_cell_past_3d, count(DISTINCT d) FILTER (WHERE dt >= -2592000e6 AND dt < 0) AS days_with_detection_past_30d_in_cell FROM ("
                "SELECT a.id, epoch_us(b.acq_time) - epoch_us(a.acq_time) AS dt, CAST(b.acq_time AS DATE) AS d FROM detections a JOIN detections b ON floor(a.lat / 0.01e0) = floor(b.lat / 0.01e0) AND floor(a.lon / 0.01e0) = floor(b.lon / 0.01e0)) a GROUP BY a.id")
add_cte("cell_history", CELL_HISTORY, ("detections",))


def _history(t):
    from hearthgrid.plans.features import same_cell_history
    return same_cell_history(t.detections.select("id", "lat", "lon", "acq_time"))


@query("win_same_cell_counts", with_ctes("cell_history") + "SELECT id, n_same_cell_24h, n_same_cell_7d FROM cell_history")
def same_cell_counts(t):
    return _history(t).select("id", "n_same_cell_24h", "n_same_cell_7d")


@query("win_seen_3d", with_ctes("cell_history") + "SELECT id, seen_same_cell_past_3d FROM cell_history")
def seen_3d(t):
    return _history(t).select("id", "seen_same_cell_past_3d")


@query("win_days_30d", with_ctes("cell_history") + "SELECT id, days_with_detection_past_30d_in_cell FROM cell_history")
def days_30d(t):
    return _history(t).select("id", "days_with_detection_past_30d_in_cell")


@query("win_max_norm", with_ctes("hindcast") + "SELECT cell_id, round(least(greatest(y_pred * 0.7e0 / max(y_pred * 0.7e0) OVER (PARTITION BY case_id, horizon_h), 0e0), 1e0), 6) AS p FROM hindcast")
def max_norm(t):
    from hearthgrid.plans.spread import normalise_by_max
    cells = t.hindcast.select("cell_id", "case_id", "horizon_h", (F.col("y_pred") * 0.7).alias("p"))
    return normalise_by_max(cells, ["case_id", "horizon_h"], "p").select("cell_id", r6(F.col("p")).alias("p"))


@query("win_monotonic", with_ctes("hindcast", extra={"a": "SELECT case_id, horizon_h, count_if(y_pred > 0.5e0) AS area FROM hindcast GROUP BY 1, 2"}) +
       "SELECT case_id, horizon_h, next_h, area, next_area FROM (SELECT *, lead(horizon_h) OVER w AS next_h, lead(area) OVER w AS next_area FROM a WINDOW w AS (PARTITION BY case_id ORDER BY horizon_h)) WHERE area > 0 AND next_area < area * 0.95e0")
def monotonic(t):
    from hearthgrid.plans.checks import footprint, shrinking
    return shrinking(footprint(t.hindcast, "case_id", "y_pred", 0.5), "case_id")


@query("win_time_fraction", with_ctes("hindcast") + "SELECT cell_id, CASE WHEN r <= CAST(floor(n * 0.8e0) AS BIGINT) THEN 'train' ELSE 'validation' END AS part FROM (SELECT cell_id, dense_rank() OVER (ORDER BY ref_time) AS r, (SELECT count(DISTINCT ref_time) FROM hindcast) AS n FROM hindcast)")
def time_fraction(t):
    from hearthgrid.plans.training import split_by_time_steps
    return split_by_time_steps(t.hindcast, "ref_time", 0.8).select("cell_id", "part")


@query("set_union", with_ctes("scores", "detections") + "SELECT id, p, CAST(NULL AS DOUBLE) AS confidence FROM scores UNION ALL SELECT id, NULL, confidence FROM detections")
def union(t):
    return t.scores.select("id", "p").unionByName(t.detections.select("id", "confidence"), allowMissingColumns=True)


@query("set_upsert_labels", D + "SELECT id, CASE WHEN ingest_batch_id >= 15 THEN 'v2' ELSE 'v1' END AS rule_version, CASE WHEN ingest_batch_id >= 15 THEN CASE WHEN k >= 70 THEN 'POSITIVE' ELSE 'NEGATIVE' END ELSE CASE WHEN k >= 50 THEN 'POSITIVE' ELSE 'NEGATIVE' END END AS label FROM detections")
def upsert_labels(t):
    def labels(df, cut, version):
        return df.select("id", F.lit(version).alias("rule_version"), F.when(F.col("k") >= cut, "POSITIVE").otherwise("NEGATIVE").alias("label"))
    return tables.upsert(labels(t.detections, 50, "v1"), labels(t.detections.where("ingest_batch_id >= 15"), 70, "v2"), "id", "rule_version")


@query("set_replace_source", with_ctes("industrial") + "SELECT source_id, kind, 1 AS version FROM industrial WHERE kind <> 'refinery' UNION ALL SELECT source_id + 1000000, kind, 2 FROM industrial WHERE kind = 'refinery'")
def replace_source(t):
    old = t.industrial.select("source_id", "kind", F.lit(1).alias("version"))
    new = t.industrial.where("kind = 'refinery'").select((F.col("source_id") + 1000000).alias("source_id"), "kind", F.lit(2).alias("version"))
    return tables.replace_slice(old, new, ["kind"])


@query("set_update_scores", D + "SELECT id, ingest_batch_id, CASE WHEN ingest_batch_id BETWEEN 10 AND 12 THEN coalesce(confidence / 100e0, 0.5e0) ELSE denoised_score END AS score FROM detections")
def update_scores(t):
    from hearthgrid.functions.scoring import confidence_norm
    table = t.detections.select("id", "ingest_batch_id", F.col("denoised_score").alias("score"))
    batch = t.detections.where("ingest_batch_id BETWEEN 10 AND 12").select("id", "ingest_batch_id", confidence_norm(F.col("confidence")).alias("score"))
    return tables.replace_slice(table, batch, ["ingest_batch_id"])


@query("set_aoi_crud", with_ctes("aois") + "SELECT aoi_id, CASE WHEN aoi_id % 3 = 0 THEN concat(name, ' (new)') ELSE name END AS name FROM aois WHERE segment <> 'HOUSEHOLD'")
def aoi_crud(t):
    base = t.aois.select("aoi_id", "name", "segment", F.lit(0).alias("seq"), F.lit(False).alias("deleted"))
    renamed = base.where("aoi_id % 3 = 0").withColumns({"name": F.concat("name", F.lit(" (new)")), "seq": F.lit(1)})
    gone = base.where("segment = 'HOUSEHOLD'").withColumns({"seq": F.lit(2), "deleted": F.lit(True)})
    return tables.apply_changes(base.unionByName(renamed).unionByName(gone), "aoi_id", ["seq"]).select("aoi_id", "name")


@query("set_except_split", S + "SELECT id FROM scores WHERE NOT id IN (SELECT id FROM scores WHERE acq_time >= TIMESTAMP '2024-01-24 00:00:00')")
def except_split(t):
    held = t.scores.where("acq_time >= TIMESTAMP_NTZ '2024-01-24 00:00:00'").select("id")
    return t.scores.select("id").join(held, "id", "left_anti")


@query("agg_label_counts", D + "SELECT CASE WHEN k >= 60 THEN 'POSITIVE' WHEN k < 40 THEN 'NEGATIVE' ELSE 'UNKNOWN' END AS label, count(*) AS n, min(acq_time) AS first_time, max(acq_time) AS last_time FROM detections GROUP BY 1")
def label_counts(t):
    from hearthgrid.plans.labels import label_counts as counts
    return counts(t.detections.withColumn("label", F.expr("CASE WHEN k >= 60 THEN 'POSITIVE' WHEN k < 40 THEN 'NEGATIVE' ELSE 'UNKNOWN' END")))


@query("join_labels", D + "SELECT id, label, frp FROM detections JOIN (SELECT id, CASE WHEN k >= 60 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label FROM detections WHERE k >= 60 OR k < 40) USING (id)")
def join_labels(t):
    from hearthgrid.plans.labels import with_labels
    labels = t.detections.where("k >= 60 OR k < 40").select("id", F.when(F.col("k") >= 60, "POSITIVE").otherwise("NEGATIVE").alias("label"), F.lit("v1.0.0").alias("rule_version"))
    return with_labels(t.detections.select("id", "frp"), labels, "v1.0.0").select("id", "label", "frp")


@query("join_features_left", with_ctes("cell_history") + "SELECT d.id, d.frp, n_same_cell_7d FROM detections d LEFT JOIN cell_history USING (id)")
def features_left(t):
    context = _history(t).select("id", "n_same_cell_7d")
    return t.detections.select("id", "frp").join(context, "id", "left")


del features
