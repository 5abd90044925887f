"""Work that must be dealt to many tasks, and tables that must not be sent to all of them."""

import random

import pytest
from pyspark.sql import functions as F

from hearthgrid import session
from hearthgrid.catalog import fields, load
from hearthgrid.catalog.projections import COARSE
from hearthgrid.operators import terrain, weather
from hearthgrid.operators.neighbours import HOUR_US, Span, neighbour_counts
from hearthgrid.plans import features, labels, spread
from hearthgrid.sources.testbed import Tables

FOLDER = "/root/testdata/sf0.001"


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("name", ["dem_cells", "weather_cells", "truth_cells", "truth_nodes"])
def test_made_rows_are_dealt_to_tasks(spark, monkeypatch, name):
    made = getattr(Tables(spark, FOLDER), name)
    total = made.count()
    monkeypatch.setattr(session, "MADE_PER_TASK", total // 8, raising=False)
    cut = getattr(Tables(spark, FOLDER), name)
    assert cut.count() == total and cut.exceptAll(made).isEmpty()
    assert largest_task(cut) <= total // 2


def test_windows_of_areas_are_dealt_to_tasks(spark, tables, monkeypatch):
    flat = COARSE.cells(spark).withColumns({"z": F.lit(1.0), "slope_deg": F.lit(0.0), "aspect_deg": F.lit(None).cast("double")})
    whole = terrain.aoi_windows(tables.aois, flat, COARSE).drop("lat", "lon")
    total = whole.count()
    monkeypatch.setattr(session, "MADE_PER_TASK", total // 16, raising=False)
    cut = terrain.aoi_windows(tables.aois, flat, COARSE).drop("lat", "lon")
    assert largest_task(cut) <= total // 4
    assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_made_cells_are_not_sent_to_every_task(tables):
    plan = plan_of(fields.pairs(tables))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_probes_are_not_sent_to_every_task(tables):
    rows = tables.detections.select("id", "lat", "lon", "acq_time")
    met = [line for line in plan_of(neighbour_counts(rows, [Span("n", 5000.0, HOUR_US, HOUR_US)])).splitlines() if "Join" in line and "q_us" in line]
    assert met and all("SortMergeJoin" in line for line in met)


def test_spread_inputs_are_worked_out_once(tables, monkeypatch):
    load()
    from hearthgrid.catalog import spreading

    winds = []
    plain = spread.mean_wind
    monkeypatch.setattr(spread, "mean_wind", lambda *a: winds.append(1) or plain(*a))
    world = spreading.World(tables)
    plan = plan_of(world.forecast().join(world.wind(), ["run_id", "horizon_h"]))
    assert len(winds) == 1
    # No kernel is added up again, no event or supplier read again, by whoever reads the forecast.
    assert "CoGroups" not in plan and "events.parquet" not in plan and "supplier.parquet" not in plan


def test_json_is_read_once_a_detection(tables):
    plan = plan_of(tables.detections.where("lat > 41 AND lon > 23").select("lat", "lon", "denoised_score"))
    assert plan.count("get_json_object") == 1


def test_elevation_is_sent_to_the_cells_not_the_cells_to_it(spark, tables):
    raster = fields.dem(tables).select("i", "j", "z")
    small = weather.with_ground(tables.weather_cells, raster, (40.05, 22.05), 0.1, 200)
    assert "BuildRight" in plan_of(small) and "BuildLeft" not in plan_of(small)
    large = weather.with_ground(tables.weather_cells, raster, (40.05, 22.05), 0.1, 200, sent_cells=0)
    assert "SortMergeJoin" in plan_of(large) and "Broadcast" not in plan_of(large)
    shown = ["run_id", "lead_h", "i", "j", "z"]
    assert small.count() == large.count() > 0 and small.select(*shown).exceptAll(large.select(*shown)).isEmpty()


def test_interpolated_corners_are_not_sent_to_every_task(tables):
    plan = plan_of(fields.aligned(tables))
    # Corners are also folded without a sort.
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "SortAggregate" not in plan


def test_labels_are_worked_out_once_for_the_split(tables):
    load()
    from hearthgrid.catalog import learning

    # The quantile and the split read written labels, not the detections again.
    assert "events.parquet" not in plan_of(learning.snapshot_split(tables))


@pytest.mark.parametrize("held_rows", [1, 40, 1 << 17])
def test_histories_of_cells_equal_brute_force(spark, monkeypatch, held_rows):
    """Blocks of one row, of some cells and of all, with copies, rows before 1970, days apart and rows without a place or time; no window."""
    monkeypatch.setattr(features, "HELD_ROWS", held_rows)
    rng = random.Random(6)
    day = 86_400
    rows = [(n, 45.0 + 0.01 * rng.randrange(3) + 0.005, -20.005, rng.choice((-1, 1_700_000_000)) * 1 + rng.randrange(80 * 24) * 3600 // rng.choice((1, 1, 30))) for n in range(300)]
    rows += [(1000, None, 1.0, 5), (1001, 45.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, s long").selectExpr("id", "lat", "lon", "CAST(timestamp_seconds(s) AS timestamp_ntz) AS acq_time")
    found = features.same_cell_history(df)
    assert "Window" not in plan_of(found)
    got = {r.id: (r.n_same_cell_24h, r.n_same_cell_7d, r.seen_same_cell_past_3d, r.days_with_detection_past_30d_in_cell) for r in found.collect()}
    placed = [r for r in rows if None not in r]
    for key, lat, lon, t in placed:
        same = [o for o in placed if o[0] != key and (o[1] // 0.01, o[2] // 0.01) == (lat // 0.01, lon // 0.01)]
        past = lambda span: [o for o in same if t - span <= o[3] <= t]
        want = (len(past(day)), len(past(7 * day)), int(any(o[3] < t for o in past(3 * day))), len({o[3] // day for o in past(30 * day) if o[3] < t}))
        assert got[key] == want
    assert set(got) == {r[0] for r in placed}


def test_features_and_labels_count_once(tables, monkeypatch):
    load()
    from hearthgrid.catalog import learning

    counted = []
    for module in (learning, features, labels):
        monkeypatch.setattr(module, "neighbour_counts", lambda *a, plain=neighbour_counts, **k: counted.append(1) or plain(*a, **k), raising=False)
    rows = learning._labelled_features(tables)
    assert len(counted) == 1 and rows.count() > 0
