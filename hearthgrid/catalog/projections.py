"""Projections and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hearthgrid.catalog.ansi import with_ctes
from hearthgrid.catalog.registry import query
from hearthgrid.functions import features, parse, scoring, spread
from hearthgrid.functions.parse import NUMBER
from hearthgrid.grid import GridSpec, normalize_lon, with_cell
from hearthgrid.operators import records

FINE = GridSpec(0.01, 40.0, 22.0, 2000, 2000)
COARSE = GridSpec(0.1, 40.0, 22.0, 200, 200)
D = with_ctes("detections")
R = with_ctes("raw_rows")


def r6(c):
    return F.round(c, 6)


def pmod_sql(x: str, n: str) -> str:
    return f"(CASE WHEN ({x}) % {n} < 0 THEN (({x}) % {n} + {n}) % {n} ELSE ({x}) % {n} END)"


def num_sql(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{NUMBER}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


CONF_TEXT_SQL = ("CASE lower(confidence_text) WHEN 'h' THEN 90e0 WHEN 'high' THEN 90e0 WHEN 'n' THEN 50e0 "
                 "WHEN 'nominal' THEN 50e0 WHEN 'l' THEN 10e0 WHEN 'low' THEN 10e0 END")
TIME_SQL = "try_strptime(concat(acq_date, ' ', lpad(coalesce(acq_time, ''), 4, '0')), '%Y-%m-%d %H%M')"
SENSOR_SQL = "coalesce(nullif(instrument, ''), nullif(satellite, ''), nullif(sensor, ''))"
BUCKET_SQL = ("CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} < 30 THEN 'low' WHEN {c} < 70 THEN 'nominal' ELSE 'high' END")
HASH_SQL = ("sha1(concat_ws('|', source, CAST(CAST(floor(lat * 10000e0 + 0.5e0) AS BIGINT) AS VARCHAR), "
            "CAST(CAST(floor(lon * 10000e0 + 0.5e0) AS BIGINT) AS VARCHAR), strftime(acq_time, '%Y-%m-%dT%H:%M:%S')))")
PARSED_SQL = (
    "SELECT *, CASE WHEN lat IS NULL OR lon IS NULL OR NOT lat BETWEEN -90 AND 90 OR NOT lon BETWEEN -180 AND 180 "
    "THEN 'invalid_coord' WHEN acq_at IS NULL THEN 'invalid_time' END AS reject_reason FROM ("
    f"SELECT row_id, source, ts, {num_sql('latitude')} AS lat, {num_sql('longitude')} AS lon, {TIME_SQL} AS acq_at, "
    f"coalesce({num_sql('confidence')}, {CONF_TEXT_SQL}) AS confidence_raw, {num_sql('brightness')} AS brightness_raw, "
    f"{num_sql('bright_t31')} AS bright_t31, {num_sql('frp')} AS frp, {SENSOR_SQL} AS sensor FROM raw_rows)"
)
ACCEPTED_SQL = (
    f"SELECT *, {HASH_SQL} AS dedupe_hash FROM (SELECT row_id, source, lat, lon, acq_at AS acq_time, sensor, "
    "CASE WHEN confidence_raw BETWEEN 0 AND 100 THEN confidence_raw END AS confidence, "
    "CASE WHEN brightness_raw BETWEEN 200 AND 500 THEN brightness_raw END AS brightness, bright_t31, frp "
    "FROM parsed WHERE reject_reason IS NULL)"
)
LANDCOVER_SQL = ("CASE WHEN {c} IN (10, 20, 30) THEN 1e0 WHEN {c} = 40 THEN 0.7e0 "
                 "WHEN {c} IN (50, 60, 70, 80, 90, 95, 100) THEN 0.1e0 ELSE 0.5e0 END")
PERSIST_SQL = ("least(1e0, CASE WHEN {n} <= 1 THEN 0.2e0 WHEN {n} <= 3 THEN 0.3e0 + ({n} - 2e0) * 0.1e0 "
               "WHEN {n} <= 9 THEN 0.5e0 + ({n} - 4e0) * 0.033e0 ELSE least(0.9e0, 0.7e0 + ({n} - 10e0) * 0.02e0) END "
               "+ CASE WHEN {s} >= 2 THEN 0.1e0 ELSE 0e0 END)")
WEATHER_SQL = ("greatest(least(0.5e0 + CASE WHEN {rh} > 70 THEN -0.3e0 ELSE 0e0 END + CASE WHEN {pr} > 10 THEN -0.2e0 ELSE 0e0 END "
               "+ CASE WHEN {rh} < 40 THEN 0.2e0 ELSE 0e0 END + CASE WHEN {ws} > 3 THEN 0.1e0 ELSE 0e0 END, 1e0), 0.1e0)")
NORM_SQL = "(CASE WHEN {c} IS NULL THEN 0.5e0 ELSE greatest(least({c}, 100e0), 0e0) / 100e0 END)"
LIKELY_SQL = ("CASE WHEN {m} THEN 0e0 ELSE greatest(least(coalesce({c}, 0.5e0) * 0.2e0 + coalesce({p}, 0.5e0) * 0.3e0 "
              "+ coalesce({l}, 0.5e0) * 0.25e0 + coalesce({w}, 0.5e0) * 0.25e0, 1e0), 0e0) END")
LEVEL_SQL = "CASE WHEN {s} < 0.3e0 THEN 'low' WHEN {s} < 0.6e0 THEN 'medium' ELSE 'high' END"


# Component scores that a list of detections may carry: the confidence score of the row, and k-based stand-ins for the others.
_SCORED = {"confidence_score": NORM_SQL.format(c="confidence"), "persistence_score": "(k % 10) / 10e0", "landcover_score": "(k % 4) / 4e0", "weather_score": "(k % 7) / 7e0"}


@query("prj_allowed", with_ctes("detections", extra={"rich": "SELECT *, " + ", ".join(f"{text} AS {name}" for name, text in _SCORED.items()) + " FROM detections"})
       + f"SELECT {', '.join(records.ALLOWED)} FROM rich")
def allowed(t):
    return records.select_allowed(t.detections.selectExpr("*", *[f"{text} AS {name}" for name, text in _SCORED.items()]), records.ALLOWED)


@query("prj_firms_parse", with_ctes("raw_rows", extra={"parsed": PARSED_SQL}) +
       "SELECT row_id, reject_reason, lat, lon, acq_at, sensor, "
       "CASE WHEN confidence_raw BETWEEN 0 AND 100 THEN confidence_raw END AS confidence, "
       "CASE WHEN brightness_raw BETWEEN 200 AND 500 THEN brightness_raw END AS brightness, bright_t31, frp FROM parsed")
def firms_parse(t):
    p = parse.parse_feed(t.raw_rows)
    return p.select("row_id", "reject_reason", "lat", "lon", "acq_at", F.col("sensor_value").alias("sensor"),
                    F.col("confidence_value").alias("confidence"), F.col("brightness_value").alias("brightness"),
                    F.col("bright_t31_value").alias("bright_t31"), F.col("frp_value").alias("frp"))


@query("prj_acq_time", R + f"SELECT row_id, {TIME_SQL} AS acq_at FROM raw_rows")
def acq_time(t):
    return t.raw_rows.select("row_id", parse.acquisition_time(F.col("acq_date"), F.col("acq_time")).alias("acq_at"))


@query("prj_opt_float", R + f"SELECT row_id, {num_sql('bright_t31')} AS a, {num_sql('brightness')} AS b, {num_sql('latitude')} AS c FROM raw_rows")
def opt_float(t):
    return t.raw_rows.select("row_id", *[parse.optional_float(F.col(c)).alias(n)
                                         for c, n in (("bright_t31", "a"), ("brightness", "b"), ("latitude", "c"))])


@query("prj_confidence_parse", R + f"SELECT row_id, coalesce({num_sql('confidence')}, {CONF_TEXT_SQL}) AS confidence FROM raw_rows")
def confidence_parse(t):
    return t.raw_rows.select("row_id", parse.confidence_value(F.col("confidence"), F.col("confidence_text")).alias("confidence"))


@query("prj_sensor_pick", R + f"SELECT row_id, {SENSOR_SQL} AS sensor FROM raw_rows")
def sensor_pick(t):
    return t.raw_rows.select("row_id", parse.first_filled(F.col("instrument"), F.col("satellite"), F.col("sensor")).alias("sensor"))


@query("prj_conf_bucket", D + f"SELECT id, {BUCKET_SQL.format(c='confidence')} AS bucket FROM detections")
def conf_bucket(t):
    return t.detections.select("id", parse.confidence_bucket(F.col("confidence")).alias("bucket"))


@query("prj_dedupe_hash", D + f"SELECT id, {HASH_SQL} AS dedupe_hash FROM detections")
def dedupe_hash(t):
    return t.detections.select("id", parse.dedupe_hash(F.col("source"), F.col("lat"), F.col("lon"), F.col("acq_time")).alias("dedupe_hash"))


@query("prj_conf_norm", D + f"SELECT id, {NORM_SQL.format(c='confidence * 1.5e0 - 20e0')} AS score FROM detections")
def conf_norm(t):
    return t.detections.select("id", scoring.confidence_norm(F.col("confidence") * 1.5 - 20.0).alias("score"))


@query("prj_conf_prior", D + f"SELECT id, round({NORM_SQL.format(c='confidence')} * 0.2e0, 6) AS prior FROM detections")
def conf_prior(t):
    return t.detections.select("id", r6(scoring.confidence_prior(F.col("confidence"))).alias("prior"))


@query("prj_likelihood", D + "SELECT id, round(" + LIKELY_SQL.format(m="false_source_masked", c="confidence / 100e0", p="denoised_score",
                                                                     l="fire_likelihood", w="k / 100e0") + ", 6) AS likelihood FROM detections")
def likelihood(t):
    c = F.col
    return t.detections.select("id", r6(scoring.likelihood(c("confidence") / 100.0, c("denoised_score"), c("fire_likelihood"),
                                                           c("k") / 100.0, c("false_source_masked"))).alias("likelihood"))


@query("prj_persist_score", D + f"SELECT id, round({PERSIST_SQL.format(n='(k % 25 + 1)', s='(id % 3)')}, 6) AS score FROM detections")
def persist_score(t):
    return t.detections.select("id", r6(scoring.persistence_score(F.col("k") % 25 + 1, F.col("id") % 3)).alias("score"))


@query("prj_landcover_score", with_ctes("landcover") + f"SELECT i, j, {LANDCOVER_SQL.format(c='class')} AS score FROM landcover")
def landcover_score(t):
    return t.landcover.select("i", "j", scoring.landcover_score(F.col("class")).alias("score"))


@query("prj_weather_score", with_ctes("weather_cells") + "SELECT run_id, lead_h, i, j, round(" +
       WEATHER_SQL.format(rh="rh2m", pr="(tp * 4000e0)", ws="sqrt(u10 * u10 + v10 * v10)") + ", 6) AS score FROM weather_cells")
def weather_score(t):
    c = F.col
    return t.weather_cells.select("run_id", "lead_h", "i", "j", r6(scoring.weather_score(
        c("rh2m"), c("tp") * 4000.0, scoring.wind_speed(c("u10"), c("v10")))).alias("score"))


@query("prj_risk_level", D + f"SELECT id, {LEVEL_SQL.format(s='fire_likelihood')} AS level FROM detections")
def risk_level(t):
    return t.detections.select("id", scoring.risk_level(F.col("fire_likelihood")).alias("level"))


@query("prj_risk_score", D + "SELECT id, round(coalesce(0.6e0 * (k / 100e0) + 0.4e0 * fire_likelihood, k / 100e0), 3) AS risk FROM detections")
def risk_score(t):
    return t.detections.select("id", F.round(scoring.risk_score(F.col("k") / 100.0, F.col("fire_likelihood")), 3).alias("risk"))


@query("prj_severity", D + "SELECT id, CASE WHEN fire_likelihood >= 0.66e0 THEN 'high' WHEN fire_likelihood >= 0.33e0 THEN 'medium' ELSE 'low' END AS severity, "
       "CASE WHEN frp > 100 THEN 4 WHEN frp > 50 THEN 3 WHEN frp > 20 THEN 2 ELSE 1 END AS frp_size FROM detections")
def severity(t):
    return t.detections.select("id", scoring.severity(F.col("fire_likelihood")).alias("severity"), scoring.frp_size(F.col("frp")).alias("frp_size"))


@query("prj_feat_firms", D + "SELECT id, coalesce(confidence, 30e0) AS confidence_norm, round(brightness - bright_t31, 6) AS brightness_minus_t31, "
       "CASE WHEN daynight = 'D' THEN 1 ELSE 0 END AS is_day FROM detections")
def feat_firms(t):
    return features.firms_features(t.detections).select("id", "confidence_norm", r6(F.col("brightness_minus_t31")).alias("brightness_minus_t31"), "is_day")


@query("prj_cat_code", with_ctes("detections", extra={"w": "SELECT sensor, row_number() OVER (ORDER BY sensor) - 1 AS c FROM (SELECT DISTINCT sensor FROM detections WHERE sensor IS NOT NULL)"}) +
       "SELECT id, CAST(coalesce(c, -1) AS INTEGER) AS code FROM detections LEFT JOIN w USING (sensor)")
def cat_code(t):
    return features.category_codes(t.detections.select("id", "sensor"), "sensor", "code").select("id", "code")


@query("prj_feat_time", D + f"""SELECT id, round(sin({2 * math.pi!r}::DOUBLE * (hour(acq_time) + minute(acq_time) / 60e0) / 24e0), 6) AS sin_hour,
 round(cos({2 * math.pi!r}::DOUBLE * (hour(acq_time) + minute(acq_time) / 60e0) / 24e0), 6) AS cos_hour,
 round(sin({2 * math.pi!r}::DOUBLE * dayofyear(acq_time) / 365.25e0), 6) AS sin_doy,
 round(cos({2 * math.pi!r}::DOUBLE * dayofyear(acq_time) / 365.25e0), 6) AS cos_doy FROM detections""")
def feat_time(t):
    return t.detections.select("id", *[r6(c).alias(n) for n, c in features.time_features(F.col("acq_time")).items()])


@query("prj_aspect_sincos", D + "SELECT id, round(sin(radians(k * 3.6e0)), 6) AS aspect_sin, round(cos(radians(k * 3.6e0)), 6) AS aspect_cos FROM detections")
def aspect_sincos(t):
    s, c = features.aspect_parts(F.col("k") * 3.6)
    return t.detections.select("id", r6(s).alias("aspect_sin"), r6(c).alias("aspect_cos"))


@query("prj_wind_speed", with_ctes("weather_cells") + "SELECT run_id, lead_h, i, j, round(sqrt(u10 * u10 + v10 * v10), 6) AS wind FROM weather_cells")
def wind_speed(t):
    return t.weather_cells.select("run_id", "lead_h", "i", "j", r6(scoring.wind_speed(F.col("u10"), F.col("v10"))).alias("wind"))


@query("prj_label_num", D + "SELECT id, CASE WHEN k >= 60 THEN 1 WHEN k < 40 THEN 0 END AS label_numeric FROM detections")
def label_num(t):
    text = F.when(F.col("k") >= 60, "POSITIVE").when(F.col("k") < 40, "NEGATIVE").otherwise("UNKNOWN")
    return t.detections.select("id", records.label_number(text).alias("label_numeric"))


@query("prj_align_features", D + "SELECT id, frp, CAST(NULL AS DOUBLE) AS elevation_m, confidence FROM detections")
def align_features(t):
    return features.align_features(t.detections, ["frp", "elevation_m", "confidence"], ["id"])


@query("prj_align_time", D + "SELECT id, date_trunc('hour', acq_time) - INTERVAL '1' HOUR * (hour(acq_time) % 6) AS run_time, "
       "CAST(48 + ceil(epoch_us(acq_time - (date_trunc('hour', acq_time) - INTERVAL '1' HOUR * (hour(acq_time) % 6))) / 3600e6) AS BIGINT) AS horizon_hours FROM detections")
def align_time(t):
    run, horizon = records.align_run_time(F.col("acq_time"), F.lit(48), 6)
    return t.detections.select("id", run.alias("run_time"), horizon.alias("horizon_hours"))


@query("prj_affine", with_ctes("weather_cells") + "SELECT run_id, lead_h, i, j, round(1.5e0 + 0.9e0 * u10, 6) AS u10, "
       "round(greatest(least(-3e0 + 1.1e0 * rh2m, 100e0), 0e0), 6) AS rh2m FROM weather_cells")
def affine(t):
    from hearthgrid.operators.weather import affine as apply
    return t.weather_cells.select("run_id", "lead_h", "i", "j", r6(apply(F.col("u10"), 1.5, 0.9)).alias("u10"),
                                  r6(apply(F.col("rh2m"), -3.0, 1.1, 0.0, 100.0)).alias("rh2m"))


@query("prj_lon_norm", D + f"SELECT id, round({pmod_sql('lon + (id % 5 - 2) * 180e0 + 180e0', '360e0')} - 180e0, 6) AS lon FROM detections")
def lon_norm(t):
    return t.detections.select("id", r6(normalize_lon(F.col("lon") + (F.col("id") % 5 - 2) * 180.0)).alias("lon"))


CELL_SQL = "CAST(floor((lat - 40e0) / {c}) AS BIGINT) AS i, CAST(floor((" + pmod_sql("lon + 180e0", "360e0") + " - 180e0 - 22e0) / {c}) AS BIGINT) AS j"


@query("prj_grid_index", with_ctes("detections", extra={"x": f"SELECT id, {CELL_SQL.format(c='0.013e0')} FROM detections"}) +
       "SELECT id, i, j, i >= 0 AND i < 1200 AND j >= 0 AND j < 1300 AS in_bounds FROM x")
def grid_index(t):
    return with_cell(t.detections, GridSpec(0.013, 40.0, 22.0, 1200, 1300)).select("id", "i", "j", "in_bounds")


@query("prj_grid_center", with_ctes("detections", extra={"x": f"SELECT id, {CELL_SQL.format(c='0.01e0')} FROM detections"}) +
       "SELECT id, round(40e0 + (i + 0.5e0) * 0.01e0, 6) AS lat_c, round(22e0 + (j + 0.5e0) * 0.01e0, 6) AS lon_c FROM x")
def grid_center(t):
    return with_cell(t.detections, FINE).select("id", r6(FINE.lat_centre(F.col("i"))).alias("lat_c"), r6(FINE.lon_centre(F.col("j"))).alias("lon_c"))


@query("prj_grid_spec", with_ctes("aois") +
       "SELECT aoi_id, round(floor(min_lat / 0.01e0) * 0.01e0, 6) AS origin_lat, round(floor(min_lon / 0.01e0) * 0.01e0, 6) AS origin_lon, "
       "CAST(ceil(max_lat / 0.01e0) - floor(min_lat / 0.01e0) AS BIGINT) AS n_lat, CAST(ceil(max_lon / 0.01e0) - floor(min_lon / 0.01e0) AS BIGINT) AS n_lon FROM aois")
def grid_spec(t):
    return t.aois.select("aoi_id", *records.snapped_grid(0.01))


@query("prj_window", with_ctes("aois") + "SELECT aoi_id, " + ", ".join(
    f"CAST(greatest(0, least({f}(({c} - {o}) / 0.1e0), 200)) AS BIGINT) AS {n}" for n, f, c, o in
    (("i0", "floor", "min_lat", "40e0"), ("i1", "ceil", "max_lat", "40e0"), ("j0", "floor", "min_lon", "22e0"), ("j1", "ceil", "max_lon", "22e0"))) + " FROM aois")
def window(t):
    return t.aois.select("aoi_id", *records.box_window(COARSE))


@query("prj_lead_time", with_ctes("weather_cells") + "SELECT run_id, lead_h, i, j, CAST(floor(epoch_us(valid_time - run_time) / 3600e6) AS BIGINT) AS lead FROM weather_cells")
def lead_time(t):
    return t.weather_cells.select("run_id", "lead_h", "i", "j", records.whole_hours(F.col("run_time"), F.col("valid_time")).alias("lead"))


@query("prj_geojson", D + "SELECT id, CAST(json_object('type', 'Feature', 'geometry', json_object('type', 'Point', 'coordinates', [lon, lat]), "
       "'properties', json_object('id', id, 'acq_time', strftime(acq_time, '%Y-%m-%dT%H:%M:%S'), 'sensor', sensor, 'confidence', confidence)) AS VARCHAR) AS feature FROM detections")
def geojson(t):
    from hearthgrid.functions.geojson import point_feature
    props = [F.col("id"), F.date_format("acq_time", "yyyy-MM-dd'T'HH:mm:ss").alias("acq_time"), F.col("sensor"), F.col("confidence")]
    return t.detections.select("id", point_feature(F.col("lon"), F.col("lat"), props).alias("feature"))


@query("prj_focus_bbox", D + "SELECT id, round(lat - 50e0 / 111e0, 6) AS min_lat, round(lat + 50e0 / 111e0, 6) AS max_lat, "
       "round(lon - 50e0 / (111e0 * cos(radians(lat))), 6) AS min_lon, round(lon + 50e0 / (111e0 * cos(radians(lat))), 6) AS max_lon FROM detections")
def focus_bbox(t):
    return t.detections.select("id", *[r6(c).alias(n) for n, c in records.focus_box(F.col("lat"), F.col("lon"), 50.0).items()])


@query("prj_truth_normalize", with_ctes("truth_cells") + "SELECT run_id, valid_time, lat, lon, u10, t2m FROM truth_cells")
def truth_normalize(t):
    from hearthgrid.operators.weather import normalize_truth
    foreign = t.truth_cells.select("run_id", F.col("valid_time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                                   F.col("u10").alias("ua"), F.col("t2m").alias("temp"))
    return normalize_truth(foreign, {"ua": "u10", "temp": "t2m"})


@query("prj_metadata_merge", with_ctes("weather_runs") + "SELECT run_id, model AS model, 'done' AS stage, CAST(horizon_hours AS VARCHAR) AS horizon FROM weather_runs")
def metadata_merge(t):
    old = F.create_map(F.lit("model"), F.col("model"), F.lit("stage"), F.lit("open"))
    new = F.create_map(F.lit("stage"), F.lit("done"), F.lit("horizon"), F.col("horizon_hours").cast("string"))
    m = F.map_concat(old, new)
    return t.weather_runs.select("run_id", *[m[k].alias(k) for k in ("model", "stage", "horizon")])


@query("prj_meta_json", with_ctes("industrial") + "SELECT source_id, CAST(json_object('source_id', source_id, 'name', name, 'kind', kind, 'lat', lat, 'lon', lon) AS VARCHAR) AS meta FROM industrial")
def meta_json(t):
    return t.industrial.select("source_id", records.row_json(t.industrial.columns).alias("meta"))


def kernel_sql(di: str, dj: str, h: str, u: str, v: str, dy: str, dx: str) -> str:
    """Text form of the decay weight with the default parameters (bias 0.2)."""
    dist = f"sqrt(({dj} * {dx}) * ({dj} * {dx}) + ({di} * {dy}) * ({di} * {dy}))"
    wind = f"sqrt({u} * {u} + {v} * {v})"
    bias = spread.KernelConfig().wind_bias
    shaped = (f"{dist} * (1e0 - {bias!r}::DOUBLE * cos(atan2({di} * {dy}, {dj} * {dx}) - atan2({v}, {u}))) / (1e0 + {wind} * 0.1e0 / {0.05 + 1e-6!r}::DOUBLE)")
    return f"exp(-(CASE WHEN {wind} > 1e-6 THEN {shaped} ELSE {dist} END) / (0.05e0 * {h} + 2e0))"


@query("prj_kernel_weight", with_ctes("weather_cells", extra={"x": "SELECT *, CAST(i - 5 AS DOUBLE) AS di, CAST(j - 5 AS DOUBLE) AS dj, 11.1e0 AS dy, 0.1e0 * (111e0 * cos(radians(lat))) AS dx FROM weather_cells"}) +
       f"SELECT run_id, lead_h, i, j, round({kernel_sql('di', 'dj', 'lead_h', 'u10', 'v10', 'dy', 'dx')}, 6) AS weight FROM x")
def kernel_weight(t):
    cfg = spread.KernelConfig()
    c = F.col
    dy, dx = spread.cell_km(0.1, c("lat"))
    w = spread.kernel_weight((c("i") - 5).cast("double"), (c("j") - 5).cast("double"), c("lead_h"), c("u10"), c("v10"), dy, dx, cfg)
    return t.weather_cells.select("run_id", "lead_h", "i", "j", r6(w).alias("weight"))
