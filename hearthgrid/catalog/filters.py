"""Filters and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgrid.catalog.ansi import add_cte, with_ctes
from hearthgrid.catalog.projections import COARSE, r6
from hearthgrid.catalog.registry import query
from hearthgrid.functions.geo import EARTH_RADIUS_M
from hearthgrid.operators import filters, polygons, runs

D = with_ctes("detections")
BOX = (25.0, 43.0, 38.0, 57.0)
START, END = "2024-01-05 06:00:00", "2024-01-20 18:30:00"


@query("flt_bbox", D + "SELECT id, lat, lon FROM detections WHERE lat BETWEEN 43 AND 57 AND lon BETWEEN 25 AND 38")
def bbox(t):
    return t.detections.where(filters.in_bbox(*BOX)).select("id", "lat", "lon")


@query("flt_time", D + f"SELECT id, acq_time FROM detections WHERE acq_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def time(t):
    return t.detections.where(filters.in_time(START, END)).select("id", "acq_time")


@query("flt_noise", D + "SELECT id, is_noise FROM detections WHERE is_noise IS NOT TRUE")
def noise(t):
    return t.detections.where(filters.not_true("is_noise")).select("id", "is_noise")


@query("flt_masked", D + "SELECT id, false_source_masked FROM detections WHERE false_source_masked IS NOT TRUE")
def masked(t):
    return t.detections.where(filters.not_true("false_source_masked")).select("id", "false_source_masked")


@query("flt_min_conf", D + "SELECT id, confidence FROM detections WHERE confidence IS NULL OR confidence >= 40")
def min_conf(t):
    return t.detections.where(filters.at_least("confidence", 40.0)).select("id", "confidence")


@query("flt_min_likelihood", D + "SELECT id, fire_likelihood FROM detections WHERE fire_likelihood IS NULL OR fire_likelihood >= 0.6e0")
def min_likelihood(t):
    return t.detections.where(filters.at_least("fire_likelihood", 0.6)).select("id", "fire_likelihood")


@query("flt_mvt", D + "SELECT id FROM detections WHERE (confidence IS NULL OR confidence >= 0) AND is_noise IS NOT TRUE AND (fire_likelihood IS NULL OR fire_likelihood >= 0.2e0)")
def mvt(t):
    return t.detections.where(filters.tile_filter(min_likelihood=0.2)).select("id")


@query("flt_presets", D + " UNION ALL ".join(
    f"SELECT '{n}' AS preset, id FROM detections WHERE acq_time BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL '{h}' HOUR AND TIMESTAMP '2024-01-15 12:00:00'"
    + (f" AND (fire_likelihood IS NULL OR fire_likelihood >= {m}e0)" if m else "") for n, (h, m) in filters.PRESETS.items()))
def presets(t):
    return t.detections.select(F.explode(filters.matching_presets("2024-01-15 12:00:00")).alias("preset"), "id")


@query("flt_pending", D + "SELECT id, ingest_batch_id FROM detections WHERE denoised_score IS NULL")
def pending(t):
    return t.detections.where("denoised_score IS NULL").select("id", "ingest_batch_id")


LABEL_SQL = "CASE WHEN k >= 60 THEN 'POSITIVE' WHEN k < 40 THEN 'NEGATIVE' ELSE 'UNKNOWN' END"


@query("flt_labelled", D + f"SELECT id, {LABEL_SQL} AS label FROM detections WHERE k >= 60 OR k < 40")
def labelled(t):
    return t.detections.withColumn("label", F.expr(LABEL_SQL)).where(F.col("label").isin("POSITIVE", "NEGATIVE")).select("id", "label")


@query("flt_aoi_search", with_ctes("aois") + "SELECT aoi_id, name FROM aois WHERE min_lon <= 30 AND max_lon >= 25 AND min_lat <= 50 AND max_lat >= 43 "
       "AND name ILIKE '%customer#0000%' ORDER BY created_at DESC, aoi_id DESC LIMIT 20 OFFSET 5")
def aoi_search(t):
    overlap = (F.col("min_lon") <= 30) & (F.col("max_lon") >= 25) & (F.col("min_lat") <= 50) & (F.col("max_lat") >= 43)
    return (t.aois.where(overlap & F.col("name").ilike("%customer#0000%"))
            .orderBy(F.desc("created_at"), F.desc("aoi_id")).offset(5).limit(20).select("aoi_id", "name"))


@query("flt_contains_box", with_ctes("weather_runs", "terrain_meta") +
       "(SELECT 'weather' AS kind, run_id AS id FROM weather_runs WHERE status = 'completed' AND run_time <= TIMESTAMP '2024-01-12 05:00:00' "
       "AND run_time >= TIMESTAMP '2024-01-11 23:00:00' AND horizon_hours >= 24 AND min_lon <= 33 AND min_lat <= 50 AND max_lon >= 34 AND max_lat >= 51 "
       "ORDER BY run_time DESC, run_id DESC LIMIT 1) UNION ALL (SELECT 'terrain' AS kind, terrain_id AS id FROM terrain_meta WHERE origin_lon <= 22.5e0 AND origin_lat <= 40.5e0 "
       "AND origin_lon + n_lon * cell >= 23.5e0 AND origin_lat + n_lat * cell >= 41.5e0 ORDER BY created_at DESC LIMIT 1)")
def contains_box(t):
    box = (33.0, 50.0, 34.0, 51.0)
    fresh = filters.in_time("2024-01-11 23:00:00", "2024-01-12 05:00:00", "run_time")
    air = (t.weather_runs.where((F.col("status") == "completed") & fresh & (F.col("horizon_hours") >= 24) & runs.stored_box_contains(*[F.lit(b) for b in box]))
           .orderBy(F.desc("run_time"), F.desc("run_id")).limit(1).select(F.lit("weather").alias("kind"), F.col("run_id").alias("id")))
    stored = t.terrain_meta.selectExpr("terrain_id", "created_at", "origin_lon AS min_lon", "origin_lat AS min_lat",
                                       "origin_lon + n_lon * cell AS max_lon", "origin_lat + n_lat * cell AS max_lat")
    land = (stored.where(runs.stored_box_contains(*[F.lit(b) for b in (22.5, 40.5, 23.5, 41.5)]))
            .orderBy(F.desc("created_at")).limit(1).select(F.lit("terrain").alias("kind"), F.col("terrain_id").alias("id")))
    return air.unionByName(land)


@query("flt_covers_coalesce", with_ctes("weather_runs") + "SELECT run_id FROM weather_runs WHERE coalesce(min_lon, -180) <= 30 AND coalesce(max_lon, 180) >= 31 "
       "AND coalesce(min_lat, -90) <= 45 AND coalesce(max_lat, 90) >= 46")
def covers_coalesce(t):
    return t.weather_runs.where(runs.covers_box(*[F.lit(b) for b in (30.0, 45.0, 31.0, 46.0)])).select("run_id")


@query("flt_candidate", with_ctes("hindcast") + "SELECT cell_id, y_pred, fire_t0 FROM hindcast WHERE fire_t0 > 0 OR y_pred >= 0.3e0")
def candidate(t):
    from hearthgrid.plans.calibration import candidates
    return candidates(t.hindcast, 0.3).select("cell_id", "y_pred", "fire_t0")


@query("flt_finite", D + "SELECT id, p FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 'nan'::DOUBLE WHEN id % 11 = 0 THEN 'infinity'::DOUBLE ELSE denoised_score END AS p FROM detections) "
       "WHERE p IS NOT NULL AND NOT isnan(p) AND NOT isinf(p)")
def finite(t):
    p = F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).when(F.col("id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("denoised_score"))
    return t.detections.select("id", p.alias("p")).where(filters.finite("p"))


add_cte("aoi_area", f"SELECT aoi_id, count(*) + 1 AS vertex_count, abs(sum(radians(x2 - x1) * (2e0 + sin(radians(y1)) + sin(radians(y2))))) * {(EARTH_RADIUS_M / 1000.0) ** 2 / 2.0!r}::DOUBLE AS area_km2, "
        "min(x1) AS lo_x, min(y1) AS lo_y, max(x1) AS hi_x, max(y1) AS hi_y FROM aoi_edges GROUP BY aoi_id", ("aoi_edges",))
KIND_SQL = "CASE WHEN segment = 'BUILDING' THEN 'Point' WHEN segment = 'MACHINERY' THEN 'MultiPolygon' ELSE 'Polygon' END"


@query("flt_aoi_rules", with_ctes("aois", "aoi_area") + f"SELECT aoi_id, CASE WHEN {KIND_SQL} NOT IN ('Polygon', 'MultiPolygon') THEN 'geometry_type' WHEN area_km2 > 1000 THEN 'too_large' END AS reject_reason "
       "FROM aois JOIN aoi_area USING (aoi_id)")
def aoi_rules(t):
    size = polygons.measures(t.aois, "aoi_id")
    rules = filters.AoiRules(max_area_km2=1000.0)
    return t.aois.select("aoi_id", F.expr(KIND_SQL).alias("kind")).join(size, "aoi_id").select(
        "aoi_id", filters.aoi_reject_reason(F.col("kind"), F.col("vertex_count"), F.col("area_km2"), rules).alias("reject_reason"))


@query("job_aoi_measures", with_ctes("aoi_area") + "SELECT aoi_id, vertex_count, round(area_km2, 3) AS area_km2, round(lo_x, 6) AS min_lon, round(lo_y, 6) AS min_lat, round(hi_x, 6) AS max_lon, round(hi_y, 6) AS max_lat FROM aoi_area")
def aoi_measures(t):
    m = polygons.measures(t.aois, "aoi_id")
    return m.select("aoi_id", "vertex_count", F.round("area_km2", 3).alias("area_km2"), *[r6(F.col(c)).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query("flt_retention", with_ctes("detections", "weather_runs", "forecast_runs") + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, {k} AS id FROM {n} WHERE {c} >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '14' DAY"
    for n, k, c in (("detections", "id", "acq_time"), ("weather_runs", "run_id", "run_time"), ("forecast_runs", "run_id", "ref_time"))))
def retention(t):
    from hearthgrid.operators.tables import keep_recent
    parts = [keep_recent(df, c, "2024-01-31 00:00:00", 14).select(F.lit(n).alias("table_name"), F.col(k).alias("id"))
             for n, df, k, c in (("detections", t.detections, "id", "acq_time"), ("weather_runs", t.weather_runs, "run_id", "run_time"),
                                 ("forecast_runs", t.forecast_runs, "run_id", "ref_time"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GRID_META = ("terrain_id, CASE WHEN terrain_id % 17 = 3 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS crs, 0e0 AS rot_x, CASE WHEN terrain_id % 19 = 2 THEN 1e-6 ELSE 0e0 END AS rot_y, "
             "cell + CASE WHEN terrain_id % 7 = 5 THEN 1e-6 ELSE 0e0 END AS cell_x, cell AS cell_y, n_lon + CASE WHEN terrain_id % 9 = 4 THEN 1 ELSE 0 END AS width, n_lat AS height, "
             "origin_lon AS left_edge, origin_lat AS bottom_edge, origin_lon, origin_lat, n_lon, n_lat, cell")
_RULES = {"crs": "crs <> 'EPSG:4326'", "rotation": "abs(rot_x) >= 1e-12 OR abs(rot_y) >= 1e-12", "square": "abs(cell_x - cell_y) > 1e-12", "cell_size": "abs(cell_x - cell) > 1e-9",
          "width": "width <> n_lon", "height": "height <> n_lat", "left": "abs(left_edge - origin_lon) > 1e-9", "bottom": "abs(bottom_edge - origin_lat) > 1e-9",
          "right": "abs(left_edge + width * cell_x - (origin_lon + n_lon * cell)) > 1e-9", "top": "abs(bottom_edge + height * cell_y - (origin_lat + n_lat * cell)) > 1e-9"}


@query("flt_dq_grid", with_ctes("terrain_meta", extra={"m": f"SELECT {GRID_META} FROM terrain_meta"}) +
       " UNION ALL ".join(f"SELECT terrain_id, '{n}' AS violation FROM m WHERE {r}" for n, r in _RULES.items()))
def dq_grid(t):
    meta = t.spark.sql(f"SELECT {GRID_META} FROM {{m}}", m=t.terrain_meta)
    own = {"crs": F.lit("EPSG:4326"), **{c: F.col(c) for c in ("cell", "n_lat", "n_lon", "origin_lat", "origin_lon")}}
    return filters.grid_violations(meta, own, "terrain_id")


@query("flt_dq_weather", with_ctes("weather_runs", "weather_cells", extra={"c": "SELECT * FROM weather_cells WHERE NOT (run_id % 6 = 1 AND lead_h > 18)"}) +
       "SELECT run_id, lead_min, lead_max, steps, CASE WHEN lead_min > 0 OR lead_max < least(horizon_hours, 72) OR steps < horizon_hours / step_hours + 1 THEN 'coverage' ELSE '' END AS violations "
       "FROM weather_runs LEFT JOIN (SELECT run_id, min(lead_h) AS lead_min, max(lead_h) AS lead_max, count(DISTINCT lead_h) AS steps FROM c GROUP BY 1) USING (run_id)")
def dq_weather(t):
    return filters.weather_violations(t.weather_cells.where("NOT (run_id % 6 = 1 AND lead_h > 18)"), t.weather_runs)


@query("flt_dq_window", with_ctes("detections", "landcover", extra={
    "a": "SELECT DISTINCT CAST(floor((lat - 40e0) / 0.1e0) AS BIGINT) AS i, CAST(floor((lon - 22e0) / 0.1e0) AS BIGINT) AS j FROM detections"}) +
       "SELECT count_if(l.i IS NULL) AS only_left, count_if(a.i IS NULL) AS only_right, count_if(a.i IS NOT NULL AND l.i IS NOT NULL AND l.j % 50 = 7) AS moved, "
       "count_if(a.i IS NOT NULL AND l.i IS NOT NULL) AS shared FROM a FULL JOIN landcover l ON a.i = l.i AND a.j = l.j")
def dq_window(t):
    fires = t.detections.select(COARSE.row(F.col("lat")).alias("i"), COARSE.col(F.col("lon")).alias("j")).distinct()
    place = {"lat": COARSE.lat_centre(F.col("i")), "lon": COARSE.lon_centre(F.col("j"))}
    land = t.landcover.select("i", "j").withColumns(place)
    land = land.withColumn("lon", F.col("lon") + F.when(F.col("j") % 50 == 7, 1e-9).otherwise(0.0))
    return filters.window_mismatch(fires.withColumns(place), land)


@query("flt_dq_labels", D + "SELECT count_if(label_numeric IS NULL OR label_numeric NOT IN (0, 1)) AS bad_labels, count(*) AS labels FROM (SELECT CASE WHEN k > 97 THEN 2 WHEN k >= 60 THEN 1 WHEN k < 40 THEN 0 END AS label_numeric FROM detections)")
def dq_labels(t):
    from hearthgrid.plans.training import bad_labels
    return bad_labels(t.detections.select(F.expr("CASE WHEN k > 97 THEN 2 WHEN k >= 60 THEN 1 WHEN k < 40 THEN 0 END").alias("label_numeric")))


@query("flt_dq_forecast", with_ctes("hindcast", extra={"h": "SELECT case_id, horizon_h, CASE WHEN cell_id % 997 = 0 THEN 'nan'::DOUBLE WHEN cell_id % 499 = 0 THEN 1.5e0 ELSE y_pred END AS p FROM hindcast"}) +
       "SELECT *, non_finite = 0 AND out_of_range = 0 AND n_horizons = 3 AS valid FROM (SELECT case_id, count_if(isnan(p)) AS non_finite, count_if(NOT isnan(p) AND (p < -1e-6 OR p > 1.000001e0)) AS out_of_range, count(DISTINCT horizon_h) AS n_horizons FROM h GROUP BY case_id)")
def dq_forecast(t):
    p = F.when(F.col("cell_id") % 997 == 0, F.lit(float("nan"))).when(F.col("cell_id") % 499 == 0, 1.5).otherwise(F.col("y_pred"))
    return filters.forecast_violations(t.hindcast.withColumn("p", p), "case_id", "p", 3)


@query("join_pip_aoi", with_ctes("detections", "aoi_edges", "aois") + "SELECT d.id, e.aoi_id FROM detections d JOIN aois a ON d.lat BETWEEN a.min_lat AND a.max_lat AND d.lon BETWEEN a.min_lon AND a.max_lon "
       "JOIN aoi_edges e ON e.aoi_id = a.aoi_id GROUP BY d.id, e.aoi_id HAVING count_if((y1 > d.lat) <> (y2 > d.lat) AND d.lon < (x2 - x1) * (d.lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1")
def pip_aoi(t):
    return polygons.points_in_polygons(t.detections.select("id", "lat", "lon"), t.aois, "aoi_id", keep=["id"])
