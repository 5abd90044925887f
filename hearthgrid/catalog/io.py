"""Sources, sinks and streams, each written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgrid.catalog.aggregates import BUCKET6, PULLS, _pulls
from hearthgrid.catalog.ansi import with_ctes
from hearthgrid.catalog.learning import FEATURE_SQL
from hearthgrid.catalog.neighbours import WGRID
from hearthgrid.catalog.projections import ACCEPTED_SQL, COARSE, LIKELY_SQL, PARSED_SQL, r6
from hearthgrid.catalog.registry import query
from hearthgrid.catalog.spreading import _RING_KEY, HORIZONS, THRESHOLDS, World, ring_sql
from hearthgrid.functions.parse import FEED_FIELDS, parse_feed
from hearthgrid.operators import tables
from hearthgrid.plans import contours, ingest, scoring
from hearthgrid.session import scratch_path
from hearthgrid.sources import readers, sinks
from hearthgrid.sources.testbed import DETECTIONS, RAW_ROWS, Tables, select_text
from hearthgrid.streaming import ingest as stream

D = with_ctes("detections")
FEED = [c for c in FEED_FIELDS if c not in ("scan", "track", "daynight")]


def _written_feed(t):
    path = scratch_path(t.spark, "feed-csv")
    t.raw_rows.select(*FEED).write.csv(path, header=True, emptyValue="")
    return path


@query("src_firms_csv", with_ctes("raw_rows") + "SELECT nullif(latitude, '') AS latitude, longitude, nullif(acq_date, '') AS acq_date, acq_time, confidence, nullif(brightness, '') AS brightness, nullif(instrument, '') AS instrument FROM raw_rows")
def firms_csv(t):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FEED])
    return readers.read_feed_csv(t.spark, _written_feed(t), schema).select("latitude", "longitude", "acq_date", "acq_time", "confidence", "brightness", "instrument")


@query("src_industrial_csv", with_ctes("industrial") + "SELECT name, kind, round(lat, 6) AS lat, round(lon, 6) AS lon, 'survey' AS source, 'v1' AS source_version FROM industrial WHERE lat BETWEEN 41 AND 58 AND lon BETWEEN 23 AND 40")
def industrial_csv(t):
    path = scratch_path(t.spark, "places-csv")
    t.industrial.select(F.col("name").alias("plant"), F.col("kind").alias("fuel"), F.col("lat").alias("y"), F.col("lon").alias("x")).write.csv(path, header=True)
    got = readers.read_places_csv(t.spark, path, "survey", "v1", "y", "x", "fuel", "plant", (23.0, 41.0, 40.0, 58.0))
    return got.select("name", "kind", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "source", "source_version")


@query("src_weather_multi", with_ctes("weather_cells") + "SELECT run_id, valid_time, i, j, u10, t2m FROM weather_cells")
def weather_multi(t):
    root = scratch_path(t.spark, "weather-files")
    t.weather_cells.where("lead_h < 12").select("run_id", "valid_time", "i", "j", "u10", "t2m").write.parquet(f"{root}/early")
    t.weather_cells.where("lead_h >= 12").select("run_id", "valid_time", "i", "j", "u10", "t2m").write.parquet(f"{root}/late")
    return readers.read_weather(t.spark, f"{root}/*")


def _labelled(t):
    label = F.when(F.col("k") >= 60, 1).when(F.col("k") < 40, 0)
    rows = t.detections.select("id", "acq_time", "frp", "confidence", label.alias("label_numeric")).where("label_numeric IS NOT NULL")
    from hearthgrid.plans.training import split_at
    return split_at(rows, "2024-01-24 00:00:00")


SNAP = D + ("SELECT id, frp, CASE WHEN k >= 60 THEN 1 ELSE 0 END AS label_numeric, CASE WHEN acq_time < TIMESTAMP '2024-01-24 00:00:00' THEN 'train' ELSE 'eval' END AS part FROM detections WHERE k >= 60 OR k < 40")


@query("src_snapshot", SNAP)
def snapshot(t):
    return readers.read_snapshot(t.spark, sinks.write_snapshot(_labelled(t))).select("id", "frp", "label_numeric", "part")


@query("snk_snapshot", D + "SELECT part, count(*) AS rows, count_if(label_numeric = 1) AS positives FROM (" + SNAP[len(D):] + ") GROUP BY part")
def snk_snapshot(t):
    path = sinks.write_snapshot(_labelled(t))
    return t.spark.read.json(f"{path}/metadata").select("part", "rows", "positives")


@query("snk_features", "SELECT x.* FROM (" + FEATURE_SQL + ") x JOIN (" + D + "SELECT id FROM detections WHERE k >= 60 OR k < 40) y USING (id)")
def snk_features(t):
    from hearthgrid.catalog.learning import _feature_row, _features
    rows = _feature_row(_features(t)).join(_labelled(t).select("id"), "id")
    return sinks.through_parquet(rows, "features")


def _cases(t):
    return t.hindcast.select("cell_id", F.col("case_id").alias("event_id"), "ref_time", "horizon_h", "i", "j", "y_pred", "y_obs", "fire_t0")


HIND = with_ctes("hindcast", extra={"ok": "SELECT case_id FROM hindcast GROUP BY 1 HAVING count_if(fire_t0 > 0) >= 175"})


@query("src_hindcast_cases", HIND + "SELECT cell_id, y_pred, y_obs FROM hindcast WHERE case_id IN (SELECT case_id FROM ok)")
def src_hindcast(t):
    return readers.read_hindcast_cases(t.spark, sinks.write_hindcast(_cases(t), 175)).select("cell_id", "y_pred", "y_obs")


@query("snk_hindcast", HIND + "SELECT case_id AS event_id, count_if(fire_t0 > 0) AS active_t0, count_if(y_obs > 0) AS positives FROM hindcast WHERE case_id IN (SELECT case_id FROM ok) GROUP BY 1")
def snk_hindcast(t):
    path = sinks.write_hindcast(_cases(t), 175)
    return readers.read_hindcast_index(t.spark, path).select("event_id", "active_t0", "positives")


@query("snk_detections", with_ctes("raw_rows", extra=PULLS) + "SELECT source, dedupe_hash FROM target UNION SELECT source, dedupe_hash FROM fresh")
def snk_detections(t):
    """Two loads into one table folder: the second appends only unseen keys, a third run appends nothing."""
    incoming, target = _pulls(t)
    path = scratch_path(t.spark, "detections")
    columns = ["source", "dedupe_hash", "lat", "lon", "acq_time", "row_id"]
    tables.first_per_key(target.select(*columns), ingest.KEYS, ["acq_time", "row_id"]).select(*columns).write.parquet(path)
    for _ in range(2):
        stored = t.spark.read.parquet(path)
        ingest.new_detections(incoming, stored).select(*columns).write.mode("append").parquet(path)
    return t.spark.read.parquet(path).select("source", "dedupe_hash")


@query("snk_batch_ledger", with_ctes("raw_rows", extra={"parsed": PARSED_SQL}) + "SELECT source, 'completed' AS status, count(*) AS fetched, count_if(reject_reason IS NOT NULL) AS skipped FROM parsed GROUP BY 1")
def batch_ledger(t):
    per = parse_feed(t.raw_rows).groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"))
    opened = per.select("source", F.lit(0).alias("seq"), F.lit("running").alias("status"), F.lit(None).cast("long").alias("fetched"), F.lit(None).cast("long").alias("skipped"))
    closed = per.select("source", F.lit(1).alias("seq"), F.lit("completed").alias("status"), "fetched", "skipped")
    log = sinks.through_parquet(opened.unionByName(closed), "ledger").withColumn("metadata", F.lit(None).cast("map<string,string>"))
    return tables.ledger_state(log, "source", "seq").select("source", "status", "fetched", "skipped")


@query("snk_run_ledger", with_ctes("weather_runs") + "SELECT run_id, status, run_time, model AS m_model, CASE WHEN status = 'completed' THEN 'stored' ELSE 'open' END AS m_stage FROM weather_runs")
def run_ledger(t):
    r = t.weather_runs
    opened = r.select("run_id", F.lit(0).alias("seq"), F.lit("running").alias("status"), "run_time", F.create_map(F.lit("model"), F.col("model"), F.lit("stage"), F.lit("open")).alias("metadata"))
    closed = r.select("run_id", F.lit(1).alias("seq"), "status", F.lit(None).cast("timestamp_ntz").alias("run_time"),
                      F.when(F.col("status") == "completed", F.create_map(F.lit("stage"), F.lit("stored"))).alias("metadata"))
    state = tables.ledger_state(sinks.through_parquet(opened.unionByName(closed), "runs"), "run_id", "seq")
    return state.select("run_id", "status", "run_time", F.col("metadata")["model"].alias("m_model"), F.col("metadata")["stage"].alias("m_stage"))


@query("snk_csv_export", D + "SELECT id, lat, lon, acq_time, confidence, frp, sensor, source FROM detections WHERE lat BETWEEN 43 AND 57 AND lon BETWEEN 25 AND 38 AND acq_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00'")
def csv_export(t):
    return sinks.export_detections(t.detections, (25.0, 43.0, 38.0, 57.0), "2024-01-05 06:00:00", "2024-01-20 18:30:00")


@query("snk_geojson_points", D + "SELECT CAST(json_object('type', 'Feature', 'geometry', json_object('type', 'Point', 'coordinates', [lon, lat]), 'properties', json_object('id', id, 'acq_time', strftime(acq_time, '%Y-%m-%dT%H:%M:%S'), 'confidence', confidence, 'frp', frp, 'sensor', sensor, 'source', source)) AS VARCHAR) AS feature FROM detections")
def geojson_points(t):
    return sinks.write_lines(sinks.point_lines(t.detections), "feature", "points")


@query("snk_geojson_aoi", with_ctes("aois") + "SELECT CAST(json_object('type', 'Feature', 'geometry', json_object('type', 'Polygon', 'coordinates', [[[cx - half * 1.2e0, cy - half], [cx + half * 1.2e0, cy - half], [cx + half * 1.5e0, cy + half], [cx - half * 1.2e0, cy + half], [cx - half * 1.2e0, cy - half]]]), 'properties', json_object('id', aoi_id, 'name', name)) AS VARCHAR) AS feature FROM aois")
def geojson_aoi(t):
    return sinks.write_lines(sinks.aoi_lines(t.aois), "feature", "aois")


@query("snk_geojson_contours", ring_sql(THRESHOLDS) + f"SELECT CAST(json_object('type', 'Feature', 'geometry', json_object('type', 'MultiPolygon', 'coordinates', coalesce(polygons, [])), 'properties', json_object('horizon_hours', horizon_h, 'threshold', threshold)) AS VARCHAR) AS feature FROM wanted LEFT JOIN shapes USING ({_RING_KEY})")
def geojson_contours(t):
    w = World(t)
    full = contours.complete_contours(w.runs, HORIZONS, THRESHOLDS, contours.contour_polygons(w.forecast(), THRESHOLDS, COARSE))
    return sinks.write_lines(sinks.contour_lines(full), "feature", "contours")


@query("snk_forecast_cells", with_ctes("forecast") + "SELECT run_id, horizon_h, count(*) AS cells, round(max(p), 6) AS top FROM forecast GROUP BY 1, 2")
def forecast_cells(t):
    stored = sinks.through_parquet(World(t).forecast().select("i", "j", "p", "run_id", "horizon_h"), "forecast", ["run_id", "horizon_h"])
    return stored.groupBy("run_id", "horizon_h").agg(F.count(F.lit(1)).alias("cells"), r6(F.max("p")).alias("top")).withColumn("horizon_h", F.col("horizon_h").cast("int"))


@query("snk_weather_layout", with_ctes("weather_cells", "weather_runs") + "SELECT model, strftime(run_time, '%Y') AS y, strftime(run_time, '%m') AS m, strftime(run_time, '%d') AS d, strftime(run_time, '%H') AS h, count(*) AS cells, count_if(min_lon IS NULL) AS global_cells FROM weather_cells JOIN (SELECT run_id, model, min_lon FROM weather_runs) USING (run_id) GROUP BY ALL")
def layout(t):
    boxes = t.weather_runs.select("run_id", "model", "min_lon", "min_lat", "max_lon", "max_lat")
    rows = sinks.weather_layout(t.weather_cells.join(boxes, "run_id")).select("run_id", "lead_h", "i", "j", "u10", "v10", "label", "model", "y", "m", "d", "h")
    stored = sinks.through_parquet(rows, "weather", ["model", "y", "m", "d", "h"])
    return stored.groupBy("model", "y", "m", "d", "h").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("label") == "global").alias("global_cells"))


@query("snk_reports", with_ctes("sweep") + "SELECT threshold, tp, fp, tn, fn FROM sweep")
def reports(t):
    from hearthgrid.operators.metrics import threshold_sweep
    return sinks.through_csv(threshold_sweep(t.scores, "y", "p").select("threshold", "tp", "fp", "tn", "fn"), "sweep")


# Streams over the events file

def _stream_events(t):
    raw = stream.parquet_stream(t.spark, t.folder, "events.parquet", t.raw("events").schema)
    return raw.withColumn("k", F.get_json_object("props", "$.k").cast("long")).drop("props")


@query("str_ingest", with_ctes("raw_rows", extra={"parsed": PARSED_SQL, "acc": ACCEPTED_SQL}) + "SELECT DISTINCT source, dedupe_hash FROM acc")
def str_ingest(t):
    rows = stream.deduplicated(_stream_events(t).selectExpr(*select_text(RAW_ROWS)))
    return stream.run_available(rows.select("source", "dedupe_hash"), "ingest")


@query("str_bucket_counts", D + f"SELECT {BUCKET6} AS ref_time, count(*) AS detections FROM detections GROUP BY 1")
def str_buckets(t):
    closed = stream.run_available(stream.bucket_counts(_stream_events(t).withColumnRenamed("ts", "acq_time"), 6), "buckets")
    return stream.with_open_windows(closed, stream.bucket_counts(t.raw("events").withColumnRenamed("ts", "acq_time"), 6), ["ref_time"])


@query("str_events", with_ctes("detections", extra={
    "r": "SELECT CAST(floor((lat - 40) / 2) AS BIGINT) AS ti, CAST(floor((lon - 22) / 2) AS BIGINT) AS tj, acq_time FROM detections",
    "g": "SELECT *, CASE WHEN acq_time - lag(acq_time) OVER (PARTITION BY ti, tj ORDER BY acq_time) < INTERVAL '9' HOUR THEN 0 ELSE 1 END AS gap FROM r", "e": "SELECT *, sum(gap) OVER (PARTITION BY ti, tj ORDER BY acq_time) AS ev FROM g"}) +
       "SELECT ti, tj, min(acq_time) AS event_start, count(*) AS detections FROM e GROUP BY ti, tj, ev")
def str_events(t):
    def tiled(d):
        return d.select(F.floor((F.col("lat") - 40) / 2).alias("ti"), F.floor((F.col("lon") - 22) / 2).alias("tj"), "acq_time")

    closed = stream.run_available(stream.events(tiled(_stream_events(t).selectExpr(*select_text(DETECTIONS))), ["ti", "tj"], 6), "events")
    return stream.with_open_windows(closed, stream.events(tiled(t.detections), ["ti", "tj"], 6), ["ti", "tj", "event_start"])


@query("str_score_batch", with_ctes("scored") + "SELECT id, round(" + LIKELY_SQL.format(m="masked", c="confidence_score", p="persistence_score", l="landcover_score", w="weather_score") + ", 6) AS fire_likelihood FROM scored")
def str_score(t):
    """Events arrive in several files, one per micro-batch; neighbours come from the whole table."""
    raw = t.raw("events")
    folder = scratch_path(t.spark, "event-files")
    raw.repartition(4, "event_id").write.parquet(folder)
    files = stream.parquet_stream(t.spark, folder, "*.parquet", raw.schema, files=1)
    rows = files.withColumn("k", F.get_json_object("props", "$.k").cast("long")).drop("props").selectExpr(*select_text(DETECTIONS))

    def side(batch):
        return Tables(batch.sparkSession, t.folder)

    steps = scoring.score_steps(lambda b: side(b).detections, lambda b: side(b).industrial, lambda b: (side(b).landcover, COARSE), lambda b: (side(b).weather_runs, side(b).weather_cells, WGRID))
    return stream.score_batches(rows.select("id", "lat", "lon", "acq_time", "sensor", "confidence"), "scores", steps, scoring.composite).select("id", r6(F.col("fire_likelihood")).alias("fire_likelihood"))


