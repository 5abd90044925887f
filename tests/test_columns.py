"""Column functions against hand-made values."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import features, parse, scoring
from hearthgrid.grid import GridSpec, normalize_lon, with_cell
from hearthgrid.operators import filters, heatmap, records
from hearthgrid.plans.risk import risk_layout
from hearthgrid.session import scratch_root


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_grid_round_trip_and_edges(spark):
    grid = GridSpec(0.01, 0.0, 0.0, 3, 3)
    pts = spark.createDataFrame([(0.001, 0.001, 2.5), (0.012, 0.025, 10.0), (0.025, 0.001, 0.0), (0.03, 0.0, 9.0)], "lat double, lon double, frp double")
    got = {(r.lat, r.lon): (r.i, r.j, r.in_bounds) for r in with_cell(pts, grid).collect()}
    assert got[(0.001, 0.001)] == (0, 0, True) and got[(0.012, 0.025)] == (1, 2, True)
    assert got[(0.03, 0.0)][2] is False
    cells = {(r.i, r.j): r.value for r in heatmap.heatmap(pts, grid, "sum", F.col("frp")).collect()}
    assert cells == {(0, 0): 2.5, (1, 2): 10.0, (2, 0): 0.0}
    with pytest.raises(ValueError):
        heatmap.heatmap(pts, grid, "median")
    assert one(spark, normalize_lon(F.lit(190.0)), normalize_lon(F.lit(180.0))) == (-170.0, -180.0)
    spec = GridSpec.from_bbox(5.014, 35.011, 5.032, 35.029, 0.01)
    assert (spec.n_lat, spec.n_lon) == (2, 3)
    w = GridSpec(0.1, 40.0, 20.0, 10, 10).window(20.0, 40.0, 21.0, 41.0)
    assert (w.i0, w.i1, w.j0, w.j1) == (0, 10, 0, 10)


def test_feed_parsing(spark):
    rows = spark.createDataFrame(
        [(1, "42.5", "23", "2024-01-01", "5", "88", None, "330", "300", "12", "VIIRS", None, None, "S"),
         (2, "bad", "23", "2024-01-01", "5", "88", None, "330", "300", "12", "VIIRS", None, None, "S"),
         (3, "95.0", "23", "2024-01-01", "5", "88", None, "330", "300", "12", "VIIRS", None, None, "S"),
         (4, "42.5", "23", "2024-01-01", "2460", "88", None, "330", "300", "12", "VIIRS", None, None, "S"),
         (5, "42.5", "23", "2024-01-01", "2359", "n", "High", "900", "1d", "nan", "", "N", None, "S"),
         (6, "42.5", "23", "2024-01-01", None, "150", None, "", "300", "12", None, "", "", "S")],
        "row_id long, latitude string, longitude string, acq_date string, acq_time string, confidence string, confidence_text string, brightness string, "
        "bright_t31 string, frp string, instrument string, satellite string, sensor string, source string")
    got = {r.row_id: r for r in parse.parse_feed(rows).collect()}
    assert [got[n].reject_reason for n in range(1, 7)] == [None, "invalid_coord", "invalid_coord", "invalid_time", None, None]
    assert got[1].acq_at == dt.datetime(2024, 1, 1, 0, 5) and got[6].acq_at == dt.datetime(2024, 1, 1)
    assert (got[5].confidence_value, got[5].brightness_value, got[5].bright_t31_value, got[5].frp_value, got[5].sensor_value) == (90.0, None, None, None, "N")
    assert (got[6].confidence_value, got[6].sensor_value) == (None, None)
    hashes = parse.accepted(parse.parse_feed(rows)).select("dedupe_hash").distinct().count()
    assert hashes == 3


def test_scores(spark):
    lit = F.lit
    norm = one(spark, *[scoring.confidence_norm(lit(c).cast("double")) for c in (None, -5, 50, 140)])
    assert norm == (0.5, 0.0, 0.5, 1.0)
    sizes = one(spark, *[F.round(scoring.persistence_score(lit(n), lit(s)), 6) for n, s in ((1, 1), (2, 1), (3, 2), (4, 1), (9, 1), (10, 1), (50, 1), (50, 2))])
    assert sizes == (0.2, 0.3, 0.5, 0.5, 0.665, 0.7, 0.9, 1.0)
    like = one(spark, *[F.round(scoring.likelihood(*[lit(x).cast("double") for x in parts], lit(masked)), 6) for parts, masked in
                        (((0.35, 0.6, 0.44, 0.12), False), ((0.9, 0.9, 0.9, 0.9), True), ((0.5, None, None, None), False), ((1.0, 1.0, 1.0, 1.0), False))])
    assert like == (0.39, 0.0, 0.5, 1.0)
    weather = one(spark, *[F.round(scoring.weather_score(*[lit(x).cast("double") for x in parts]), 6) for parts in
                           ((80.0, 20.0, 0.0), (30.0, 0.0, 5.0), (None, None, None), (50.0, None, None), (80.0, 20.0, None))])
    assert weather == (0.1, 0.8, None, 0.5, 0.1)
    assert one(spark, *[scoring.landcover_score(lit(c)) for c in (10, 40, 80, 7)]) == (1.0, 0.7, 0.1, 0.5)


def test_time_features(spark):
    noon, midnight = (F.lit(f"2024-06-01 {h}:00:00").cast("timestamp_ntz") for h in ("12", "00"))
    a, b = features.time_features(noon), features.time_features(midnight)
    got = one(spark, *[F.round(c, 6) for c in (a["sin_hour"], a["cos_hour"], b["sin_hour"], b["cos_hour"])])
    assert got == (0.0, -1.0, 0.0, 1.0)


def test_three_valued_filters(spark):
    df = spark.createDataFrame([(1, None, None), (2, True, 10.0), (3, False, 90.0)], "id int, is_noise boolean, confidence double")
    assert {r.id for r in df.where(filters.not_true("is_noise")).collect()} == {1, 3}
    assert {r.id for r in df.where(filters.at_least("confidence", 50)).collect()} == {1, 3}


def test_run_alignment_and_allow_list(spark):
    run, horizon = records.align_run_time(F.lit("2024-01-01 08:30:00").cast("timestamp_ntz"), F.lit(24))
    assert one(spark, run, horizon) == (dt.datetime(2024, 1, 1, 6), 27)
    df = spark.createDataFrame([(1, 2.0)], "id int, lat double")
    with pytest.raises(ValueError):
        records.select_allowed(df, [])
    with pytest.raises(ValueError):
        records.select_allowed(df, ["id", "password"])


def test_risk_layout_honours_the_cell_size_and_a_given_limit():
    whole = risk_layout((20.0, 40.0, 30.0, 50.0), 1.0)
    assert whole.n_lat == 1110 and whole.n_lat * whole.n_lon > 800_000
    g = risk_layout((20.0, 40.0, 30.0, 50.0), 1.0, max_cells=500)
    assert g.n_lat * g.n_lon <= 500
    assert risk_layout((20.0, 40.0, 20.05, 40.05), 10.0).n_lat == 1


def test_scratch_needs_a_shared_folder_on_a_cluster(tmp_path):
    def fake(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            scratch_root(fake(master))
        assert scratch_root(fake(master, f"{tmp_path}/")) == str(tmp_path)
    assert scratch_root(fake("local[4]"))
