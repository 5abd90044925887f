"""Table changes, metrics, terrain, spread, contours and streams on small hand-made inputs."""

import bisect
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions.spread import KernelConfig, kernel_half, kernel_weight
from hearthgrid.grid import GridSpec
from hearthgrid.operators import metrics, ordered, polygons, raster, tables, weather
from hearthgrid.plans import calibration, contours, hindcast, spread, training
from hearthgrid.session import scratch_path
from hearthgrid.sources import sinks


def test_insert_ignore_is_idempotent(spark):
    new = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("b", "1", 3)], "source string, hash string, seq int")
    empty = new.limit(0)
    first = tables.insert_ignore(empty, new, ["source", "hash"], ["seq"])
    assert sorted((r.source, r.seq) for r in first.collect()) == [("a", 1), ("b", 3)]
    assert tables.insert_ignore(first, new, ["source", "hash"], ["seq"]).count() == 0


def test_ledger_merges_right_over_left(spark):
    log = spark.createDataFrame([(1, 0, "running", "t0", {"a": "1", "b": "1"}), (1, 1, "done", None, {"b": "2"})],
                                "id int, seq int, status string, run_time string, metadata map<string,string>")
    r = tables.ledger_state(log, "id", "seq").first()
    assert (r.status, r.run_time, r.metadata) == ("done", "t0", {"a": "1", "b": "2"})


def test_change_log_and_slices(spark):
    log = spark.createDataFrame([(1, 0, "x", False), (1, 1, "y", False), (2, 0, "z", False), (2, 1, "z", True)], "id int, seq int, name string, deleted boolean")
    assert [(r.id, r.name) for r in tables.apply_changes(log, "id", ["seq"]).collect()] == [(1, "y")]
    old = spark.createDataFrame([(1, "s", 1), (2, "t", 1)], "id int, src string, v int")
    new = spark.createDataFrame([(9, "s", 1)], "id int, src string, v int")
    assert sorted(r.id for r in tables.replace_slice(old, new, ["src", "v"]).collect()) == [2, 9]


def test_dynamic_overwrite_replaces_only_its_partitions(spark):
    path = scratch_path(spark, "slices")
    spark.createDataFrame([(1, 0), (2, 1)], "id int, batch int").write.partitionBy("batch").parquet(path)
    sinks.overwrite_slices(spark.createDataFrame([(3, 1)], "id int, batch int"), path, ["batch"])
    assert sorted((r.id, r.batch) for r in spark.read.parquet(path).collect()) == [(1, 0), (3, 1)]


def test_ranking_metrics_against_pairs(spark):
    rng = random.Random(1)
    rows = [(k, int(rng.random() < 0.4), rng.randrange(20) / 20) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, y int, p double")
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = metrics.ranking_metrics(df, "y", "p").first()
    assert got.roc_auc == pytest.approx(auc)
    one_class = metrics.ranking_metrics(df.where("y = 1"), "y", "p").first()
    assert one_class.roc_auc is None and one_class.average_precision is None
    sweep = {round(r.threshold, 2): (r.tp, r.fp, r.tn, r.fn) for r in metrics.threshold_sweep(df, "y", "p").collect()}
    for t in (0.0, 0.35, 0.5, 1.0):
        assert sweep[t] == (sum(p >= t for p in pos), sum(p >= t for p in neg), sum(p < t for p in neg), sum(p < t for p in pos))
    q = ordered.quantiles(df, "p", {"a": 0.3, "m": 0.5}).first()
    ranked = sorted(p for _, _, p in rows)
    assert q.m == pytest.approx((ranked[149] + ranked[150]) / 2)


def test_crowded_values_are_dealt_to_many_ranges(spark):
    """Scores within a hair of each other: ranges follow the values, so no task holds them all."""
    rng = random.Random(2)
    rows = [(k, int(rng.random() < 0.5), 0.5 + rng.random() * 1e-7) for k in range(4000)] + [(9000, 1, 0.0), (9001, 0, 1.0)]
    df = spark.createDataFrame(rows, "id int, y int, p double")
    sizes = [r["count"] for r in ordered.dealt_by_range(df.groupBy("p").agg(F.sum("y").alias("y")), "p").groupBy("_range").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2500
    ranked = sorted(p for _, _, p in rows)
    assert ordered.quantiles(df, "p", {"m": 0.5}).first().m == pytest.approx((ranked[2000] + ranked[2001]) / 2, abs=1e-15)
    pos, neg = sorted(p for _, y, p in rows if y), sorted(p for _, y, p in rows if not y)
    pairs = sum(bisect.bisect_left(neg, p) + (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p)) / 2 for p in pos)
    assert metrics.ranking_metrics(df, "y", "p").first().roc_auc == pytest.approx(pairs / (len(pos) * len(neg)))
    placed = {(r["y"], r["id"]): r["rank"] for r in ordered.grouped_rank(df.withColumn("o", F.col("p") + F.col("id") * 1e-12), ["y"], "o").collect()}
    for y in (0, 1):
        own = sorted((p + k * 1e-12, k) for k, a, p in rows if a == y)
        assert all(placed[y, k] == n + 1 for n, (_, k) in enumerate(own))


def test_probability_bins_are_left_closed(spark):
    got = spark.range(1).select(*[metrics.probability_bin(F.lit(p)) for p in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0)]).first()
    assert tuple(got) == (0, 1, 2, 5, 6, 9)


def test_stratified_split_has_both_classes(spark):
    df = spark.range(200).withColumn("y", (F.col("id") < 2).cast("int"))
    parts = training.split_stratified(df, "y", "id", 0.2, 7)
    assert parts.where("part = 'eval'").count() == 40
    assert parts.where("part = 'eval' AND y = 1").count() >= 1 and parts.where("part = 'train' AND y = 1").count() >= 1
    assert parts.exceptAll(training.split_stratified(df, "y", "id", 0.2, 7)).count() == 0


def test_negative_sampling_quota(spark):
    rows = spark.range(100).select(F.lit(1).alias("run_id"), F.lit(6).alias("horizon_h"), F.col("id").alias("i"), F.lit(0).alias("j"),
                                   F.lit(0.0).alias("fire_t0"), (F.col("id") < 2).cast("int").alias("label"))
    assert hindcast.sample_negatives(rows, 5.0).count() == 12


def test_events_split_at_gaps(spark):
    hours = [0, 6, 12, 36, 42]
    times = spark.createDataFrame([(0, h) for h in hours], "k int, h int").select("k", F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz").alias("ref_time"))
    sizes = sorted(r["count"] for r in hindcast.group_events(times, ["k"], 6).groupBy("event_start").count().collect())
    assert sizes == [2, 3]


def test_slope_and_aspect(spark):
    def plane(expr):
        cells = GridSpec(0.01, 0.0, 0.0, 6, 6).cells(spark).withColumns({"z": F.expr(expr), "r": F.lit(1)})
        return raster.slope_aspect(cells, 0.01, F.lit(0.0), ["r"])

    east = plane("CAST(j AS DOUBLE) * 10").select(F.round("aspect_deg", 6)).distinct().collect()
    north = plane("CAST(i AS DOUBLE) * 10").select(F.round("aspect_deg", 6)).distinct().collect()
    flat = plane("5e0").select("slope_deg", "aspect_deg").distinct().collect()
    assert [r[0] for r in east] == [270.0] and [r[0] for r in north] == [180.0]
    assert [tuple(r) for r in flat] == [(0.0, None)]


def test_bias_fit_guards(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2.0, 5.0, None, 1.0), (2.0, 5.0, 2.0, 7.0, float("nan"), 1.0)],
                               "a double, truth_a double, b double, truth_b double, c double, truth_c double")
    r = weather.fit_bias(df, ["a", "b", "c"]).first()
    assert (round(r.a.alpha, 9), round(r.a.beta, 9)) == (1.0, 2.0)
    assert (r.b.alpha, r.b.beta) == (6.0, 0.0) and (r.c.alpha, r.c.beta) == (0.0, 1.0)
    assert spark.range(1).select(weather.affine(F.lit(None).cast("double"), 0.0, 1.0, 0.0, 100.0)).first()[0] is None


def test_kernel_bias_and_growth(spark):
    cfg = KernelConfig()
    lit = lambda x: F.lit(float(x))
    w = lambda di, dj, h, u: kernel_weight(lit(di), lit(dj), lit(h), lit(u), lit(0), lit(1), lit(1), cfg)
    calm_e, calm_w, down, up, soon, late = spark.range(1).select(w(0, 3, 6, 0), w(0, -3, 6, 0), w(0, 3, 6, 10), w(0, -3, 6, 10), w(0, 3, 6, 0), w(0, 3, 48, 0)).first()
    assert calm_e == calm_w and down > up and late > soon
    halves = spark.range(1).select(kernel_half(lit(6), lit(0), lit(1), lit(1), cfg), kernel_half(lit(72), lit(30), lit(1), lit(1), cfg)).first()
    assert tuple(halves) == (3, 659)  # three reaches, uncut
    assert spark.range(1).select(kernel_half(lit(72), lit(30), lit(1), lit(1), KernelConfig(max_width=201))).first()[0] == 100
    uphill = KernelConfig(slope_bias=True)
    up_n, up_s = spark.range(1).select(*[kernel_weight(lit(d), lit(0), lit(6), lit(0), lit(0), lit(1), lit(1), uphill, lit(30), lit(180)) for d in (3, -3)]).first()
    assert up_n > up_s  # downslope is south, so north is easier
    with pytest.raises(ValueError):
        KernelConfig(max_width=8)


@pytest.mark.parametrize("grid, bias", [(GridSpec(0.1, 40.0, 22.0, 200, 150), False), (GridSpec(0.1, 40.0, 22.0, 30, 9), True)])
def test_kernel_sums_equal_the_sum_over_all_pairs(spark, grid, bias):
    """Narrow kernels with many blocks, and kernels wider than the window; cells on block borders and in corners."""
    rng = random.Random(8)
    cells = {(r, i, j) for r in (1, 2) for i, j in [(0, 0), (grid.n_lat - 1, grid.n_lon - 1), (63, 64), (64, 63), *[(rng.randrange(grid.n_lat), rng.randrange(grid.n_lon)) for _ in range(25)]] if i < grid.n_lat and j < grid.n_lon}
    active = spark.createDataFrame([(*c, 0.5) for c in cells] + [(1, 3, 3, 0.0), (3, 1, 1, 0.9)], "run_id long, i long, j long, fire double").dropDuplicates(["run_id", "i", "j"])
    wind = spark.createDataFrame([(1, 6, 0.0, 0.0), (1, 24, 9.0, -4.0), (2, 12, -30.0, 2.0), (4, 6, 1.0, 1.0)], "run_id long, horizon_h int, u double, v double")
    ground = spark.createDataFrame([(0, 0, 12.0, 100.0)], "i long, j long, slope_deg double, aspect_deg double") if bias else None
    cfg = KernelConfig(slope_bias=bias)
    dy, dx = spread.cell_km(grid.cell, F.lit(grid.origin_lat + grid.n_lat * grid.cell / 2))
    tilt = (F.lit(12.0), F.lit(100.0)) if bias else (None, None)
    reach = wind.withColumn("half", kernel_half(F.col("horizon_h"), F.sqrt(F.col("u") ** 2 + F.col("v") ** 2), dy, dx, cfg))
    pairs = active.where("fire > 0").join(reach, "run_id").withColumn("ti", F.explode(F.sequence(F.lit(0), F.lit(grid.n_lat - 1)))).withColumn("tj", F.explode(F.sequence(F.lit(0), F.lit(grid.n_lon - 1))))
    pairs = pairs.where("abs(ti - i) <= half AND abs(tj - j) <= half")
    weight = kernel_weight((F.col("ti") - F.col("i")).cast("double"), (F.col("tj") - F.col("j")).cast("double"), F.col("horizon_h"), F.col("u"), F.col("v"), dy, dx, cfg, *tilt)
    want = {tuple(r)[:4]: r["p"] for r in pairs.groupBy("run_id", "horizon_h", "ti", "tj").agg(F.sum(weight).alias("p")).collect()}
    got = {tuple(r)[:4]: r["p"] for r in spread.kernel_sums(active, wind, grid, cfg, ground).collect()}
    assert got.keys() == want.keys() and len({k[1] for k in got}) == 3
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-300) for k, v in want.items())


def test_missing_horizon_is_an_error(spark):
    f = spark.createDataFrame([(1, 6, 0, 0, 0.5)], "run_id int, horizon_h int, i int, j int, p double")
    assert spread.horizon_slice(f, 1, 6).count() == 1
    with pytest.raises(ValueError):
        spread.horizon_slice(f, 1, 12)
    with pytest.raises(ValueError):
        spread.model("nope")


def _area(ring):
    return sum(a["lon"] * b["lat"] - b["lon"] * a["lat"] for a, b in zip(ring, ring[1:])) / 2


def test_contours_with_hole_and_touching_corners(spark):
    grid = GridSpec(10.0, 0.0, 0.0, 6, 6)
    ring = [(1, i, j, 0.9) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    corner = [(2, 0, 0, 0.9), (2, 1, 1, 0.9)]
    single = [(3, 1, 1, 0.9)]
    df = spark.createDataFrame([(r, 6, i, j, p) for r, i, j, p in ring + corner + single], "run_id long, horizon_h int, i long, j long, p double")
    got = {(r.run_id, r.threshold): r.polygons for r in contours.contour_polygons(df, [0.5], grid).collect()}
    assert len(got[(1, 0.5)]) == 1 and [round(_area(x)) for x in got[(1, 0.5)][0]] == [900, -100]
    assert sorted(len(p) for p in got[(2, 0.5)]) == [1, 1]
    only = got[(3, 0.5)][0][0]
    assert _area(only) == 100 and {(p["lon"], p["lat"]) for p in only} == {(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)}
    runs = spark.createDataFrame([(3,), (4,)], "run_id long")
    lines = sinks.contour_lines(contours.complete_contours(runs, [6], [0.5], contours.contour_polygons(df, [0.5], grid))).collect()
    shapes = {r.run_id: json.loads(r.feature)["geometry"] for r in lines}
    assert shapes[4] == {"type": "MultiPolygon", "coordinates": []} and len(shapes[3]["coordinates"]) == 1
    summary = {r.run_id: r.area_deg2 for r in contours.contour_summary(df, [0.5], grid).collect()}
    assert summary == {1: 800.0, 2: 200.0, 3: 100.0}


def test_point_in_polygon_with_hole(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
    poly = spark.createDataFrame([(7, [[{"lon": x, "lat": y} for x, y in r] for r in (square, hole)])], "k int, rings array<array<struct<lon: double, lat: double>>>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 5.0, 5.0)], "id int, lat double, lon double")
    assert [r.id for r in polygons.points_in_polygons(pts, poly, "k").collect()] == [1]
    m = polygons.measures(poly, "k").first()
    assert m.vertex_count == 10 and 140_000 < m.area_km2 < 150_500


def _inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_points_in_polygons_of_many_vertices(spark):
    """Rings of 10,000 vertices, one a star with a hole, a comb whose every tooth is as tall as the polygon, and small ones; points on vertices' latitudes too."""
    rng = random.Random(4)
    star = [((4 + 3 * (k % 2)) * math.cos(math.pi * k / 5000) + 10, (4 + 3 * (k % 2)) * math.sin(math.pi * k / 5000) + 10) for k in range(10_000)]
    hole = [(9.0, 9.0), (11.0, 9.0), (11.0, 11.0), (9.0, 11.0)]
    comb = [(20 + k / 50, float(k % 2)) for k in range(400)] + [(28.0, -1.0), (20.0, -1.0)]
    flat = [(0.0, 0.0), (5.0, 0.0), (2.0, 0.0)]
    shapes = {1: [star, hole], 2: [comb], 3: [[(10.0, 10.0), (12.0, 10.0), (12.0, 12.0), (10.0, 12.0)]], 4: [flat],
              5: [[((6 + 0.2 * math.sin(k / 50)) * math.cos(math.pi * k / 5000) + 10, 6 * math.sin(math.pi * k / 5000) + 10) for k in range(10_000)]]}
    shapes = {k: [[*r, r[0]] for r in rings] for k, rings in shapes.items()}
    poly = spark.createDataFrame([(k, [[{"lon": x, "lat": y} for x, y in r] for r in rings], 5) for k, rings in shapes.items()],
                                 "k int, rings array<array<struct<lon: double, lat: double>>>, slab int").drop("slab")
    places = [(rng.uniform(2, 18), rng.uniform(2, 18)) for _ in range(800)] + [(rng.uniform(19, 29), rng.uniform(-1.2, 1.2)) for _ in range(600)]
    places += [(rng.uniform(3, 17), y) for _, y in rng.sample(star, 100)] + [(10.5, 9.0), (10.0, 10.0), (12.0, 12.0), (3.0, 0.0)]
    rows = [(n, x, y) for n, (x, y) in enumerate(places)]
    pts = spark.createDataFrame([*rows, rows[0], rows[0]], "id int, lon double, lat double")
    got = sorted((r.id, r.k) for r in polygons.points_in_polygons(pts, poly, "k").collect())
    want = [(n, k) for n, x, y in [*rows, rows[0], rows[0]] for k, rings in shapes.items() if _inside(x, y, rings)]
    assert got == sorted(want) and {k for _, k in want} == {1, 2, 3, 5}
    shape, listed = polygons.slabs(poly, "k")
    entries = {r["k"]: r["count"] for r in listed.groupBy("k").count().collect()}
    counts = {r["k"]: r["slabs"] for r in shape.collect()}
    assert all(entries.get(k, 0) <= 3 * sum(map(len, rings)) for k, rings in shapes.items()) and counts[5] > 1000 and counts[2] < 4


def test_points_in_polygons_cut_up_and_far_from_edges(spark):
    """Wide shapes whose edges lie bins away, corners on bin borders, a bow-tie and an open ring; bins cut into parts of points and edges."""
    rng = random.Random(9)
    shapes = {1: [[(-6.0, -3.0), (7.0, -3.0), (7.0, 3.0), (-2.0, 3.0), (-2.0, 1.0), (5.5, 1.0), (5.5, -1.25), (-6.0, -1.25), (-6.0, -3.0)], [(0.1, -2.0), (3.7, -2.0), (3.7, -1.5), (0.1, -1.5), (0.1, -2.0)]],
              2: [[(-5.0, -2.0), (5.0, 2.2), (5.0, -2.0), (-5.0, 2.2), (-5.0, -2.0)]], 3: [[(-4.0, -2.5), (6.0, 0.0), (-4.0, 2.5)]], 4: [[(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.5, 0.5)]]}
    poly = spark.createDataFrame([(k, [[{"lon": x, "lat": y} for x, y in r] for r in rings]) for k, rings in shapes.items()], "k int, rings array<array<struct<lon: double, lat: double>>>")
    rows = [(n, rng.uniform(-7, 8), rng.uniform(-4, 4)) for n in range(1500)] + [(2000 + n, x / 2, y / 2) for n, (x, y) in enumerate((x, y) for x in range(-13, 16) for y in range(-7, 8))]
    pts = spark.createDataFrame([*rows, (3000, None, 1.0), (3001, float("nan"), 1.0)], "id int, lon double, lat double")
    boxes = {k: [f(v) for v in zip(*(p for r in rings for p in r)) for f in (min, max)] for k, rings in shapes.items()}
    want = sorted((n, k) for n, x, y in rows for k, rings in shapes.items() if _inside(x, y, rings) and boxes[k][0] <= x <= boxes[k][1])
    for cuts in ({}, {"asked_points": 3, "held_edges": 2}):
        found = polygons.points_in_polygons(pts, poly, "k", keep=["id"], **cuts)
        assert found.columns == ["id", "k"] and sorted(map(tuple, found.collect())) == want
    # What lies inside is told where points and edges meet: pairs are neither grouped nor dealt out.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan.split("MapInArrow")[0] for word in ("Aggregate", "Exchange", "Join"))


def test_calibration_lowers_the_error(spark):
    rng = random.Random(0)
    rows = [(k % 4, 24, p, float(rng.random() < p * p), 1.0) for k in range(3000) for p in [rng.random()]]
    cells = spark.createDataFrame(rows, "case_id int, horizon_h int, y_pred double, y_obs double, fire_t0 double")
    for method in ("isotonic", "platt"):
        fitted = calibration.fit(cells, method)
        r = calibration.evaluate(calibration.apply(cells, fitted)).first()
        assert r.brier_cal < r.brier_raw and r.ece_cal < r.ece_raw
    unknown = calibration.apply(cells.withColumn("horizon_h", F.lit(6)), fitted)
    assert unknown.where("y_cal <> y_pred").count() == 0


def test_export_request_is_checked():
    with pytest.raises(ValueError):
        sinks.validate_export((10, 0, 5, 5), "2024-01-01", "2024-01-02")
    with pytest.raises(ValueError):
        sinks.validate_export((0, 0, 5, 5), "2024-01-03", "2024-01-02")


def test_overlapping_csv_pulls_stream_to_the_batch_result(spark, tables):
    from hearthgrid.functions.parse import FEED_SCHEMA, accepted, parse_feed
    from hearthgrid.streaming.ingest import csv_stream, deduplicated, run_available

    fields = [f.name for f in FEED_SCHEMA.fields]
    raw = tables.raw_rows
    full = raw.select(*[(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in fields], "ts")
    folder = scratch_path(spark, "pulls")
    for low, high in (("2024-01-01", "2024-01-06"), ("2024-01-04", "2024-01-09")):
        full.where(f"ts >= TIMESTAMP_NTZ '{low} 00:00:00' AND ts < TIMESTAMP_NTZ '{high} 00:00:00'").drop("ts").coalesce(1).write.mode("append").csv(folder, header=True)
    stream = deduplicated(csv_stream(spark, folder, FEED_SCHEMA).withColumn("source", F.lit("feed"))).select("source", "dedupe_hash")
    got = run_available(stream, "csv")
    batch = accepted(parse_feed(spark.read.csv(folder, header=True, schema=FEED_SCHEMA).withColumn("source", F.lit("feed")))).select("source", "dedupe_hash").distinct()
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_batch_is_scored_against_the_whole_table(spark, tables):
    from hearthgrid.plans.scoring import clusters

    rows = tables.detections.select("id", "lat", "lon", "acq_time", "sensor")
    whole = {r.id: (r.cluster_size, r.sensor_count) for r in clusters(rows).collect()}
    batch = rows.where("id % 5 = 0")
    got = {r.id: (r.cluster_size, r.sensor_count) for r in clusters(batch, history=rows.where("id % 5 <> 0")).collect()}
    assert got == {k: v for k, v in whole.items() if k % 5 == 0} and any(v[0] > 1 for v in got.values())


def test_failing_score_step_leaves_nulls(spark, tables):
    from hearthgrid.streaming import ingest

    def broken(rows):
        return rows.select("id", F.raise_error(F.lit("no score today")).cast("double").alias("weather_score"))

    folder = scratch_path(spark, "some-events")
    rows = tables.detections.select("id", "frp").limit(40)
    rows.repartition(2).write.parquet(folder)
    steps = {"fine": (lambda r: r.select("id", (F.col("id") * 2).alias("twice")), "twice bigint"), "weather": (broken, "weather_score double")}
    out = ingest.score_batches(ingest.parquet_stream(spark, folder, "*.parquet", rows.schema, files=1), "broken", steps, lambda scored: scored).collect()
    assert len(out) == 40 and all(r.twice == 2 * r.id and r.weather_score is None for r in out) and len({r.batch_id for r in out}) == 2
