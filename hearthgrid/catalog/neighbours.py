"""Distance joins, land-cover and weather look-ups, and the scoring job."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgrid.catalog.ansi import add_cte, haversine, metres, with_ctes
from hearthgrid.catalog.projections import COARSE, LANDCOVER_SQL, LIKELY_SQL, NORM_SQL, PERSIST_SQL, WEATHER_SQL, r6
from hearthgrid.catalog.registry import query
from hearthgrid.operators.neighbours import HOUR_US, Span, attach_counts, micros, neighbour_counts
from hearthgrid.operators.nearest import nearest_before
from hearthgrid.operators.proximity import near_any
from hearthgrid.operators.raster import sample_cell
from hearthgrid.operators.runs import as_of_run
from hearthgrid.operators.weather import weather_at_points
from hearthgrid.plans import scoring as plan
from hearthgrid.sources.testbed import WEATHER_NODES, WEATHER_ORIGIN, WEATHER_STEP_DEG

WGRID = (*WEATHER_ORIGIN, WEATHER_STEP_DEG, WEATHER_NODES)
DIST = metres("a.lat", "a.lon", "b.lat", "b.lon")


def near_sql(deg: str, radius: str) -> str:
    return f"abs(a.lat - b.lat) < {deg} AND abs(a.lon - b.lon) < {deg} AND {DIST} <= {radius}"


add_cte("masked", f"SELECT DISTINCT a.id FROM detections a JOIN industrial b ON {near_sql('0.02e0', '500e0')}", ("detections", "industrial"))
add_cte("near_industrial", f"SELECT DISTINCT a.id FROM detections a JOIN industrial b ON {near_sql('0.06e0', '2000e0')}", ("detections", "industrial"))
add_cte("cluster", "SELECT a.id, count(DISTINCT b.id) AS cluster_size, count(DISTINCT b.sensor) AS sensor_count, "
        "coalesce(string_agg(DISTINCT b.sensor, ',' ORDER BY b.sensor), '') AS sensors FROM detections a JOIN detections b "
        f"ON b.acq_time BETWEEN a.acq_time - INTERVAL '72' HOUR AND a.acq_time AND {near_sql('0.02e0', '750e0')} GROUP BY a.id", ("detections",))
add_cte("around", "SELECT a.id, count_if(d <= 2000e0 AND dt BETWEEN -86400e6 AND 86400e6) - 1 AS n_2km, "
        "count_if(dt BETWEEN -86400e6 AND 86400e6) - 1 AS n_5km, "
        "count_if(d <= 2000e0 AND dt BETWEEN -21600e6 AND 0) - 1 AS n_2km_6h, count_if(d <= 2000e0 AND dt BETWEEN -86400e6 AND 0) - 1 AS n_2km_24h, "
        "count_if(dt BETWEEN -21600e6 AND 0) - 1 AS n_5km_6h, count_if(dt BETWEEN -86400e6 AND 0) - 1 AS n_5km_24h FROM ("
        f"SELECT a.id, {DIST} AS d, epoch_us(b.acq_time) - epoch_us(a.acq_time) AS dt FROM detections a JOIN detections b "
        f"ON b.acq_time BETWEEN a.acq_time - INTERVAL '24' HOUR AND a.acq_time + INTERVAL '24' HOUR AND {near_sql('0.12e0', '5000e0')}) a GROUP BY a.id", ("detections",))
add_cte("chosen_run", "SELECT id, run_id, run_time, lat, lon, acq_time FROM (SELECT d.id, d.lat, d.lon, d.acq_time, r.run_id, r.run_time, "
        "row_number() OVER (PARTITION BY d.id ORDER BY r.run_time DESC, r.created_at DESC, r.run_id DESC) AS rn "
        "FROM detections d JOIN weather_runs r ON r.status = 'completed' AND r.run_time <= d.acq_time AND r.run_time >= d.acq_time - INTERVAL '6' HOUR "
        "AND coalesce(r.min_lon, -180e0) <= d.lon AND coalesce(r.max_lon, 180e0) >= d.lon "
        "AND coalesce(r.min_lat, -90e0) <= d.lat AND coalesce(r.max_lat, 90e0) >= d.lat) WHERE rn = 1", ("detections", "weather_runs"))
add_cte("air", "SELECT a.id, a.run_id, max_by(c.rh2m, -abs(epoch_us(c.valid_time) - epoch_us(a.acq_time))) AS rh2m, "
        "max_by(sqrt(c.u10 * c.u10 + c.v10 * c.v10), -abs(epoch_us(c.valid_time) - epoch_us(a.acq_time))) AS wind_ms, "
        "sum(c.tp) FILTER (WHERE c.valid_time BETWEEN a.acq_time - INTERVAL '72' HOUR AND a.acq_time) * 1000e0 AS precip_mm "
        "FROM chosen_run a JOIN weather_cells c ON c.run_id = a.run_id AND c.i = CAST(least(greatest(floor((a.lat - 40e0) / 2e0 + 0.5e0), 0), 10) AS BIGINT) "
        "AND c.j = CAST(least(greatest(floor((a.lon - 22e0) / 2e0 + 0.5e0), 0), 10) AS BIGINT) GROUP BY a.id, a.run_id", ("chosen_run", "weather_cells"))
add_cte("cover", "SELECT d.id, l.class FROM detections d LEFT JOIN landcover l ON l.i = CAST(floor((d.lat - 40e0) / 0.1e0) AS BIGINT) "
        "AND l.j = CAST(floor((d.lon - 22e0) / 0.1e0) AS BIGINT)", ("detections", "landcover"))
add_cte("air_score", "SELECT id, " + WEATHER_SQL.format(rh="rh2m", pr="precip_mm", ws="wind_ms") + " AS weather_score FROM air", ("air",))


@query("join_mask_industrial", with_ctes("masked") + "SELECT id, id IN (SELECT id FROM masked) AS masked FROM detections")
def mask_industrial(t):
    return near_any(t.detections.select("id", "lat", "lon"), t.industrial, 500.0, "masked").select("id", "masked")


@query("join_industrial_label", with_ctes("near_industrial") + "SELECT id FROM near_industrial")
def industrial_label(t):
    return near_any(t.detections.select("id", "lat", "lon"), t.industrial, 2000.0, "hit").where("hit").select("id")


@query("join_persist_neighbors", with_ctes("cluster") + "SELECT id, cluster_size, sensor_count FROM cluster")
def persist_neighbors(t):
    return plan.clusters(t.detections.select("id", "lat", "lon", "acq_time", "sensor")).select("id", "cluster_size", "sensor_count")


@query("agg_cluster", with_ctes("cluster") + "SELECT sensors, count(*) AS detections, CAST(sum(cluster_size) AS BIGINT) AS members, max(cluster_size) AS largest FROM cluster GROUP BY sensors")
def agg_cluster(t):
    got = plan.clusters(t.detections.select("id", "lat", "lon", "acq_time", "sensor"))
    return got.groupBy(F.array_join("sensors", ",").alias("sensors")).agg(
        F.count("*").alias("detections"), F.sum("cluster_size").alias("members"), F.max("cluster_size").alias("largest"))


DAY = 24 * HOUR_US
SINGLETON = Span("n_5km", 5000.0, DAY, DAY)
COMPANION = Span("n_2km", 2000.0, DAY, DAY)


@query("join_singleton_anti", with_ctes("around") + "SELECT id FROM detections JOIN around USING (id) WHERE confidence < 30 AND n_5km = 0")
def singleton_anti(t):
    d = t.detections.select("id", "lat", "lon", "acq_time", "confidence")
    return attach_counts(d, neighbour_counts(d, [SINGLETON])).where("confidence < 30 AND n_5km = 1").select("id")


@query("join_cluster_semi", with_ctes("around") + "SELECT id FROM around WHERE n_2km > 0")
def cluster_semi(t):
    d = t.detections.select("id", "lat", "lon", "acq_time")
    return attach_counts(d, neighbour_counts(d, [COMPANION])).where("n_2km > 1").select("id")


@query("join_radius_counts", with_ctes("around") + "SELECT id, n_2km_6h, n_2km_24h, n_5km_6h, n_5km_24h FROM around")
def radius_counts(t):
    from hearthgrid.plans.features import radius_counts as counts
    return counts(t.detections.select("id", "lat", "lon", "acq_time")).select("id", "n_2km_6h", "n_2km_24h", "n_5km_6h", "n_5km_24h")


def _points(t):
    return t.detections.select("id", "lat", "lon", micros(F.col("acq_time")).alias("t_us"))


@query("join_asof_weather_run", with_ctes("chosen_run") + "SELECT id, run_id, run_time FROM chosen_run")
def asof_weather_run(t):
    return as_of_run(_points(t), t.weather_runs)


@query("join_weather_nearest", with_ctes("air") + "SELECT id, run_id, rh2m, round(wind_ms, 6) AS wind_ms FROM air")
def weather_nearest(t):
    return weather_at_points(_points(t), t.weather_runs, t.weather_cells, WGRID).select("id", "run_id", "rh2m", r6(F.col("wind_ms")).alias("wind_ms"))


@query("agg_precip_lookback", with_ctes("air") + "SELECT id, round(precip_mm, 6) AS precip_mm FROM air")
def precip_lookback(t):
    return weather_at_points(_points(t), t.weather_runs, t.weather_cells, WGRID).select("id", r6(F.col("precip_mm")).alias("precip_mm"))


@query("job_weather_score", with_ctes("air_score") + "SELECT id, round(coalesce(weather_score, 0.5e0), 6) AS weather_score FROM detections LEFT JOIN air_score USING (id)")
def job_weather_score(t):
    scores = plan.weather_scores(t.detections, t.weather_runs, t.weather_cells, WGRID)
    return t.detections.select("id").join(scores, "id", "left").select("id", r6(F.coalesce("weather_score", F.lit(0.5))).alias("weather_score"))


@query("join_raster_point", with_ctes("cover") + f"SELECT id, class AS cover_class, {LANDCOVER_SQL.format(c='class')} AS score FROM cover")
def raster_point(t):
    from hearthgrid.functions.scoring import landcover_score
    got = sample_cell(t.detections.select("id", "lat", "lon"), t.landcover, COARSE, "class", "cover_class")
    return got.select("id", "cover_class", landcover_score(F.col("cover_class")).alias("score"))


add_cte("scored", "SELECT d.id, cluster_size, sensor_count, d.id IN (SELECT id FROM masked) AS masked, "
        f"{NORM_SQL.format(c='d.confidence')} AS confidence_score, {PERSIST_SQL.format(n='cluster_size', s='sensor_count')} AS persistence_score, "
        f"{LANDCOVER_SQL.format(c='cover.class')} AS landcover_score, coalesce(weather_score, 0.5e0) AS weather_score "
        "FROM detections d JOIN cluster USING (id) JOIN cover USING (id) LEFT JOIN air_score USING (id)", ("masked", "cluster", "cover", "air_score"))


@query("job_score_detections", with_ctes("scored") + "SELECT id, cluster_size, sensor_count, masked, round(confidence_score, 6) AS confidence_score, "
       "round(persistence_score, 6) AS persistence_score, landcover_score, round(weather_score, 6) AS weather_score, round(" +
       LIKELY_SQL.format(m="masked", c="confidence_score", p="persistence_score", l="landcover_score", w="weather_score") + ", 6) AS fire_likelihood FROM scored")
def score_detections(t):
    return _rounded_scores(t, t.detections)


BATCH = 5


@query("job_score_batch", with_ctes("scored") + "SELECT id, cluster_size, sensor_count, masked, round(confidence_score, 6) AS confidence_score, "
       "round(persistence_score, 6) AS persistence_score, landcover_score, round(weather_score, 6) AS weather_score, round(" +
       LIKELY_SQL.format(m="masked", c="confidence_score", p="persistence_score", l="landcover_score", w="weather_score") +
       f", 6) AS fire_likelihood FROM scored JOIN (SELECT id FROM detections WHERE ingest_batch_id = {BATCH}) USING (id)")
def score_batch(t):
    """One ingest batch, its neighbours taken from the whole table."""
    return _rounded_scores(t, t.detections.where(F.col("ingest_batch_id") == BATCH), t.detections)


def _rounded_scores(t, rows, history=None):
    got = plan.score_detections(rows, t.industrial, t.landcover, COARSE, t.weather_runs, t.weather_cells, WGRID, history)
    rounded = ("confidence_score", "persistence_score", "weather_score", "fire_likelihood")
    return got.select("id", "cluster_size", "sensor_count", "masked", "landcover_score", *[r6(F.col(c)).alias(c) for c in rounded])


add_cte("nn_pairs", f"SELECT a.id, (a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon) AS planar, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM detections a JOIN detections b "
        "ON b.acq_time BETWEEN a.acq_time - INTERVAL '24' HOUR AND a.acq_time AND b.id <> a.id", ("detections",))
add_cte("nn_least", "SELECT id, min(planar) AS planar FROM nn_pairs GROUP BY 1", ("nn_pairs",))
add_cte("nearest", "SELECT d.id, round(coalesce(km, 999e0), 6) AS dist_nn_24h_km FROM detections d LEFT JOIN (SELECT x.id, min(km) AS km FROM nn_pairs x JOIN nn_least m ON x.id = m.id AND x.planar = m.planar GROUP BY 1) y USING (id)",
        ("detections", "nn_pairs", "nn_least"))


@query("join_nn_24h", with_ctes("nearest") + "SELECT * FROM nearest")
def nn_24h(t):
    d = t.detections.select("id", "lat", "lon", "acq_time")
    return attach_counts(d, nearest_before(d)).select("id", r6(F.col("nn_km")).alias("dist_nn_24h_km"))
