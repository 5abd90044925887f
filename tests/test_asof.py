"""Merged as-of joins against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hearthgrid import session
from hearthgrid.operators import asof, weather
from hearthgrid.operators import runs as run_tables
from hearthgrid.operators.asof import last_before
from hearthgrid.operators.runs import as_of_run, latest_run_at, latest_run_for_boxes

RUN = "run_id long, run_time timestamp_ntz, created_at timestamp_ntz, status string, min_lon double, min_lat double, max_lon double, max_lat double"
HOUR = 3_600_000_000


@pytest.fixture(params=[1, 4, 9])
def tasks(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_last_before(spark, tasks):
    rng = random.Random(tasks)
    known = [(k, t, f"{k}-{t}") for k, times in {1: [0, 10, 20], 2: [500], 3: [], -4: list(range(-300, 300, 7))}.items() for t in times]
    asked = [(n, rng.choice([1, 2, 3, -4, 5, None]), rng.choice([None, 10, 20, rng.randrange(-400, 600)])) for n in range(400)]
    asked += [(1000 + n, 1, 15) for n in range(300)] + [(5000, 1, 15), (5000, 1, 15)]  # one moment, repeated rows
    got = last_before(spark.createDataFrame(asked, "id long, k int, t long"), spark.createDataFrame(known, "k int, t long, name string"), "k", "t", ["name"]).collect()
    want = []
    for n, k, t in asked:
        before = [x for x in known if k is not None and t is not None and x[0] == k and x[1] <= t]
        want.append((n, k, t, max(before, key=lambda x: x[1])[2] if before else None))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_one_moment_is_dealt_to_all_tasks(spark):
    asked = spark.range(4000).select("id", F.lit(7).alias("k"), F.lit(100).alias("t"))
    known = spark.createDataFrame([(7, 5, "old"), (7, 90, "new"), (7, 101, "late"), (8, 95, "other")], "k int, t long, name string")
    got = last_before(asked, known, "k", "t", ["name"])
    assert got.groupBy("name").count().collect()[0].asDict() == {"name": "new", "count": 4000}
    assert got.where("name <> 'new'").count() == 0


def test_without_known_or_asked_rows(spark):
    asked = spark.createDataFrame([(1, 7, 100)], "id long, k int, t long")
    known = spark.createDataFrame([(7, 90, "new")], "k int, t long, name string")
    assert [r["name"] for r in last_before(asked, known.limit(0), "k", "t", ["name"]).collect()] == [None]
    assert last_before(asked.limit(0), known, "k", "t", ["name"]).collect() == []


def run_rows(rng):
    boxes = [(None,) * 4, (0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 30.0, 30.0), (None, None, 8.0, 8.0), (-180.0, -90.0, 180.0, 90.0)]
    return [(n, rng.randrange(0, 80), rng.randrange(100), rng.choice(["completed", "completed", "failed"]), *rng.choice(boxes)) for n in range(120)]


def covers(run, box):
    low_lon, low_lat, high_lon, high_lat = (v if v is not None else d for v, d in zip(run[4:], (-180.0, -90.0, 180.0, 90.0)))
    return low_lon <= box[0] and high_lon >= box[2] and low_lat <= box[1] and high_lat >= box[3]


def table(spark, runs):
    rows = spark.createDataFrame(runs, "run_id long, h int, c int, status string, min_lon double, min_lat double, max_lon double, max_lat double")
    at = lambda c: F.timestamp_micros(F.col(c) * F.lit(HOUR)).cast("timestamp_ntz")
    return rows.withColumns({"run_time": at("h"), "created_at": at("c")}).select(*[f.split()[0] for f in RUN.split(", ")])


def best(runs, hour, box, oldest=None):
    fit = [r for r in runs if r[3] == "completed" and r[1] <= hour and (oldest is None or r[1] >= oldest) and covers(r, box)]
    return max(fit, key=lambda r: (r[1], r[2], r[0]))[0] if fit else None


def test_runs_for_points_boxes_and_moments(spark, tasks):
    rng = random.Random(tasks + 50)
    runs = run_rows(rng)
    points = [(n, rng.uniform(-5, 35), rng.uniform(-5, 35), rng.choice([40, rng.randrange(0, 100)])) for n in range(300)] + [(900, 10.0, 10.0, 50), (901, 0.0, 5.0, 50)]
    asked = spark.createDataFrame([(n, lat, lon, h * HOUR) for n, lat, lon, h in points], "id long, lat double, lon double, t_us long")
    got = {r["id"]: r["run_id"] for r in as_of_run(asked, table(spark, runs)).collect()}
    want = {n: best(runs, h, (lon, lat, lon, lat), h - 6) for n, lat, lon, h in points}
    assert got == {k: v for k, v in want.items() if v is not None}
    boxes = [(n, lon, lat, lon + rng.uniform(0, 6), lat + rng.uniform(0, 6), h) for n, lat, lon, h in points[:100]]
    frame = spark.createDataFrame(boxes, "id long, min_lon double, min_lat double, max_lon double, max_lat double, h int").withColumn("at", F.timestamp_micros(F.col("h") * F.lit(HOUR)).cast("timestamp_ntz"))
    got = {r["id"]: r["run_id"] for r in latest_run_for_boxes(frame, table(spark, runs)).collect()}
    want = {b[0]: best(runs, b[5], b[1:5]) for b in boxes}
    assert got == {k: v for k, v in want.items() if v is not None}
    got = {r["id"]: r["run_id"] for r in latest_run_at(frame.select("id", "at"), table(spark, runs)).collect()}
    newest = lambda h: max((r for r in runs if r[3] == "completed" and r[1] <= h), key=lambda r: (r[1], r[2], r[0]), default=(None,))[0]
    assert got == {b[0]: newest(b[5]) for b in boxes if newest(b[5]) is not None}


def counting(monkeypatch, counts):
    for module in (asof, run_tables):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", lambda df, name: counts.append(session.materialize(df, name)) or counts[-1])


def test_points_do_not_ask_once_for_each_box(spark, monkeypatch):
    forecast = [(n, n % 10, n, "completed", -10.0 - n, -10.0 - n, 40.0 + n, 40.0 + n) for n in range(60)]
    points = [(n, n * 0.01, n * 0.02, n % 16) for n in range(1500)]
    asked = spark.createDataFrame([(n, lat, lon, h * HOUR) for n, lat, lon, h in points], "id long, lat double, lon double, t_us long")
    written = []
    counting(monkeypatch, written)
    got = {r["id"]: r["run_id"] for r in as_of_run(asked, table(spark, forecast)).collect()}
    assert got == {n: best(forecast, h, (lon, lat, lon, lat), h - 6) for n, lat, lon, h in points if h <= 15}
    assert max(df.count() for df in written) <= len(points)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_runs_for_odd_points(spark, monkeypatch, sent):
    monkeypatch.setattr(run_tables, "SENT_OFFERS", sent, raising=False)
    rng = random.Random(7)
    # Nearly as many boxes as runs, more than one row of offers a tile, and boxes over the borders of tiles and of the world.
    forecast = [(n, rng.randrange(0, 12), rng.randrange(5), "completed", *rng.choice([
        (None,) * 4, (-180.0, -90.0, 0.0, 0.0), (x := rng.uniform(-20, 15), y := rng.uniform(-20, 15), x + rng.uniform(0, 30), y + rng.uniform(0, 30)),
        (5.0, 5.0, 5.0, 5.0), (170.0, 0.0, -170.0, 10.0), (-500.0, -500.0, -100.0, 500.0)])) for n in range(700)]
    forecast += [(900, 30, 1, "completed", None, None, None, None), (901, 50, 1, "completed", 0.0, 0.0, 5.0, 5.0), (902, 20, 1, "failed", None, None, None, None)]
    places = [(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(250)] + [(0.0, 0.0), (5.0, 5.0), (-90.0, -180.0), (90.0, 180.0), (95.0, 10.0), (10.0, 190.0), (10.0, -300.0), (float("nan"), 3.0), (2.0, float("inf"))]
    points = [(n, lat, lon, rng.choice([0, 3, 11, 17, 30, 36, 37, 50, 56])) for n, (lat, lon) in enumerate(places)]
    rows = [(n, lat, lon, h * HOUR) for n, lat, lon, h in points] + [(n, lat, lon, h * HOUR) for n, lat, lon, h in points[:20]]  # repeated rows
    rows += [(2000, None, 1.0, HOUR), (2001, 1.0, None, HOUR), (2002, 1.0, 1.0, None), (2003, 1.0, 1.0, 36 * HOUR + 1), (2004, 1.0, 1.0, 30 * HOUR - 1)]
    out = as_of_run(spark.createDataFrame(rows, "id long, lat double, lon double, t_us long"), table(spark, forecast)).collect()
    want = {n: best(forecast, h, (lon, lat, lon, lat), h - 6) for n, lat, lon, h in points}
    assert len(out) == len({r["id"] for r in out})
    assert {r["id"]: r["run_id"] for r in out} == {k: v for k, v in want.items() if v is not None}


def test_cells_of_other_runs_are_dropped_where_they_are_read(spark):
    points = spark.createDataFrame([(1, 0.4, 0.4, HOUR), (2, 1.2, 0.1, 2 * HOUR)], "id long, lat double, lon double, t_us long")
    forecast = table(spark, [(n, n % 2, n, "completed", None, None, None, None) for n in range(50)])
    step = F.timestamp_micros(F.col("lead") * F.lit(HOUR)).cast("timestamp_ntz").alias("valid_time")
    cells = spark.range(50).select(F.col("id").alias("run_id"), F.explode(F.array([F.lit(x) for x in range(3)])).alias("lead")).select(
        "run_id", step, F.explode(F.array([F.lit(x).cast("long") for x in range(3)])).alias("i"), F.lit(0).cast("long").alias("j"),
        *[(F.col("run_id") + F.col("lead") * n).cast("double").alias(c) for n, c in enumerate(("u10", "v10", "rh2m", "tp"))])
    found = weather.weather_at_points(points, forecast, cells, (0.0, 0.0, 1.0, 3))
    # The first join over the cells keeps the chosen runs; nothing is dealt out between.
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftSemi" in line]
    assert joins and re.search(r"BroadcastHashJoin \[run_id#\w+\], ", joins[-1])
    assert {r["id"]: (r["run_id"], r["rh2m"], r["precip_mm"]) for r in found.collect()} == {1: (49, 51.0, 1000.0 * (49 + 52)), 2: (49, 53.0, 1000.0 * (49 + 52 + 55))}
