"""Distance operators against brute force, on sparse, crowded, polar and date-line data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.functions.geo import haversine_km
from hearthgrid.operators import nearest, neighbours
from hearthgrid.operators.nearest import nearest_before
from hearthgrid.operators.neighbours import HOUR_US, Span, neighbour_counts
from hearthgrid.operators.proximity import near_any


def metres(a, b):
    phi = math.radians((a[0] + b[0]) / 2)
    north = 111132.954 - 559.822 * math.cos(2 * phi) + 1.175 * math.cos(4 * phi)
    east = 111412.84 * math.cos(phi) - 93.5 * math.cos(3 * phi) + 0.118 * math.cos(5 * phi)
    dlon = (b[1] - a[1] + 540) % 360 - 180
    return math.hypot(north * (b[0] - a[0]), east * dlon)


def cloud(seed, n=260):
    """A crowded spot, copies of one detection, points over the date line and points near the pole."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        place = k % 5
        lat, lon = {0: (45.0, 20.0), 1: (45.0, 20.0), 2: (10.0, 179.999), 3: (82.0, 50.0), 4: (45.0, 20.03)}[place]
        lat, lon = lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-0.02, 0.02)
        if k % 7 == 0:
            lat, lon = 45.0, 20.0
        lon = (lon + 180) % 360 - 180
        when = rng.randrange(0, 200) * 1800 if k % 7 else (k % 21) * 3600
        rows.append((k, lat, lon, when, ("VIIRS", "MODIS", None)[k % 3]))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, lat double, lon double, secs long, sensor string")
    return df.withColumn("acq_time", F.timestamp_seconds(F.col("secs") + 1_700_000_000).cast("timestamp_ntz")).drop("secs")


@pytest.mark.parametrize("crowded_rows", [10_000, 4])
def test_counts_equal_brute_force(spark, crowded_rows):
    rows = cloud(3)
    spans = [Span("a", 750.0, 72 * HOUR_US), Span("b", 2000.0, 6 * HOUR_US, 6 * HOUR_US), Span("c", 2000.0, 24 * HOUR_US)]
    got = neighbour_counts(frame(spark, rows), spans, group="sensor", crowded_rows=crowded_rows).collect()
    found = {(r.lat, r.lon, r.t_us // 1_000_000 - 1_700_000_000): (r.a, r.b, r.c, tuple(r.members)) for r in got}
    for _, lat, lon, when, _ in rows:
        near = [(o, metres((lat, lon), (o[1], o[2])), o[3] - when) for o in rows]
        a = [o for o, d, t in near if d <= 750 and -72 * 3600 <= t <= 0]
        b = sum(d <= 2000 and abs(t) <= 6 * 3600 for _, d, t in near)
        c = sum(d <= 2000 and -24 * 3600 <= t <= 0 for _, d, t in near)
        assert found[(lat, lon, when)] == (len(a), b, c, tuple(sorted({o[4] for o in a if o[4]})))


@pytest.mark.parametrize("group, asking_rows", [("sensor", 1 << 17), (None, 3)])
def test_busy_cells_equal_pairs(spark, monkeypatch, group, asking_rows):
    """Cells held by one task, also with their targets cut up, count as pairs do, and make no pairs of their rows."""
    monkeypatch.setattr(neighbours, "ASKING_ROWS", asking_rows)
    monkeypatch.setattr(neighbours, "TAGS", 2)
    rows = frame(spark, cloud(11, 400)).withColumn("sensor", F.when(F.col("id") < 300, F.col("sensor")))
    spans = [Span("a", 750.0, 72 * HOUR_US), Span("b", 2000.0, 6 * HOUR_US, 6 * HOUR_US)]
    pairs = neighbour_counts(rows, spans, group=group, busy_rows=10_000)
    held = neighbour_counts(rows, spans, group=group, busy_rows=1, asking=rows.where("id % 3 > 0"))
    mixed = neighbour_counts(rows, spans, group=group, busy_rows=4, crowded_rows=12)
    assert "CoGroupsInArrow" in held._jdf.queryExecution().executedPlan().toString()
    assert mixed.exceptAll(pairs).isEmpty() and pairs.exceptAll(mixed).isEmpty()
    wanted = pairs.join(rows.where("id % 3 > 0").select("lat", "lon", neighbours.micros(F.col("acq_time")).alias("t_us")).distinct(), neighbours.POINT, "left_semi")
    assert held.exceptAll(wanted).isEmpty() and wanted.exceptAll(held).isEmpty()


def test_plain_counts_in_pieces_equal_pairs(spark, monkeypatch):
    """Running sums over positions a few at a time, and probes that are dealt out only where few rows are, give what pairs give."""
    rows = frame(spark, cloud(17, 300))
    spans = [Span("a", 750.0, 72 * HOUR_US), Span("b", 2000.0, 6 * HOUR_US, 6 * HOUR_US), Span("c", 2000.0, 24 * HOUR_US)]
    monkeypatch.setattr(neighbours, "SENT_CELLS", 0)
    pairs = neighbour_counts(rows, spans, busy_rows=10_000)
    want = sorted(map(tuple, pairs.collect()))
    monkeypatch.setattr(neighbours, "SENT_CELLS", 10_000)
    monkeypatch.setattr(neighbours, "LOOKED_AT", 50)
    for busy_rows in (0, 5):
        assert sorted(map(tuple, neighbour_counts(rows, spans, busy_rows=busy_rows).collect())) == want
    plan = neighbour_counts(rows, spans)._jdf.queryExecution().executedPlan().toString()
    probed = [line for line in plan.splitlines() if "LeftSemi" in line and "BroadcastHashJoin" in line and "cell_row" in line]
    assert probed and sum(sum(c) for _, _, _, *c in want) > 1000


def test_within_equals_metres():
    rng = np.random.default_rng(2)
    asked = rng.uniform(-90, 90, 400) + 1j * rng.uniform(-180, 180, 400)
    sites = np.concatenate([asked.real + rng.normal(0, 0.02, 400) + 1j * ((asked.imag + rng.normal(0, 0.04, 400) + 180) % 360 - 180), [89.999 + 179.9j, 89.999 - 179.9j]])
    exact = np.stack([neighbours._metres(p.real, p.imag, sites.real, sites.imag) for p in asked])
    radii = (2000.0, 5000.0, float(exact[7, 7]), float(exact[9, 9]))
    for radius, inside in zip(radii, neighbours._within(asked, sites, radii)):
        assert (inside == (exact <= radius)).all() and inside.any()


@pytest.mark.parametrize("crowded_rows", [10_000, 2])
def test_nearest_equals_brute_force(spark, crowded_rows):
    rows = cloud(5, 200) + [(900, -30.0, -60.0, 300_000, None), (901, -30.0, -61.5, 290_000, None), (902, 60.0, 100.0, 9_000_000, None)]
    got = {(r.lat, r.lon, r.t_us // 1_000_000 - 1_700_000_000): r.nn_km for r in nearest_before(frame(spark, rows), crowded_rows=crowded_rows).collect()}
    for key, lat, lon, when, _ in rows:
        past = [o for o in rows if o[0] != key and 0 <= when - o[3] <= 86400]
        if not past:
            assert got[(lat, lon, when)] == 999.0
            continue
        best = min((o[1] - lat) ** 2 + (o[2] - lon) ** 2 for o in past)
        ties = [o for o in past if (o[1] - lat) ** 2 + (o[2] - lon) ** 2 <= best * (1 + 1e-12)]

        def km(o):
            h = math.sin(math.radians(o[1] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(o[1])) * math.sin(math.radians(o[2] - lon) / 2) ** 2
            return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

        assert got[(lat, lon, when)] == pytest.approx(min(km(o) for o in ties), abs=1e-6)

@pytest.mark.parametrize("met_rows, held_rows", [(4096, 1 << 19), (5, 60)])
def test_nearest_in_tiles_equals_pairs(spark, monkeypatch, met_rows, held_rows):
    """Crowds, rows on tile borders and days apart, equal distances, a busy place, and targets far from all: tiles, wider tiles and the walk agree with all pairs."""
    monkeypatch.setattr(nearest, "MET_ROWS", met_rows)
    monkeypatch.setattr(nearest, "COMPARED_ROWS", 50)
    rng = random.Random(3)
    day = 86_400
    spots = [(rng.gauss(1.6, 0.01), rng.gauss(-1.6, 0.01), rng.randrange(5 * day)) for _ in range(150)] + [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.randrange(4 * day)) for _ in range(60)]
    spots += [(0.5, 0.5, day + 600 * k) for k in range(40)] + [(50.0 + a, 100.0 + b, 2 * day + k) for k, (a, b) in enumerate([(-0.25, 0), (0, 0.25), (0.25, 0), (0, -0.25), (0, 0)])]
    spots += [(-80.0, -170.0, 3 * day), (80.0, 170.0, 2 * day + 30), (80.0, 170.0, 4 * day), (1.6, 1.6, 0), (1.6, 1.6, day), (1.6, 1.6, 2 * day + 1)]
    rows = frame(spark, [(n, lat, lon, t, None) for n, (lat, lon, t) in enumerate(spots)])
    got = {r.id: r.nn_km for r in neighbours.attach_counts(rows, nearest.nearest_before(rows, crowded_rows=held_rows)).collect()}
    a, b = (rows.select("id", "lat", "lon", neighbours.micros(F.col("acq_time")).alias("t")).toDF(*[f"{c}_{x}" for c in ("id", "lat", "lon", "t")]) for x in "ab")
    pairs = a.join(b, F.expr(f"t_b BETWEEN t_a - {24 * HOUR_US} AND t_a AND id_a <> id_b"))
    scored = pairs.withColumns({"planar": F.expr("(lat_a - lat_b) * (lat_a - lat_b) + (lon_a - lon_b) * (lon_a - lon_b)"), "km": haversine_km("lat_a", "lon_a", "lat_b", "lon_b")})
    want = {r.id_a: r.best.km for r in scored.groupBy("id_a").agg(F.min(F.struct("planar", "km")).alias("best")).collect()}
    for n in range(len(spots)):
        assert got[n] == pytest.approx(want.get(n, 999.0), abs=1e-9), (n, spots[n])


def test_targets_with_nothing_before_them_do_not_walk(spark, monkeypatch):
    """One detection that is first, far or alone must not send all others through the tree."""
    monkeypatch.setattr(nearest, "_walk_down", lambda *a: pytest.fail("walked"))
    rows = frame(spark, [(1, 10.0, 10.0, 0, None), (2, 10.001, 10.0, 60, None), (3, -40.0, 60.0, 100, None), (4, 10.0, 10.0, 10 * 86_400, None)])
    got = {r.id: round(r.nn_km, 3) for r in neighbours.attach_counts(rows, nearest_before(rows)).collect()}
    assert got[1] == got[4] == 999.0 and got[2] == 0.111 and got[3] > 5000


def test_near_any_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 10.0, 179.999), (2, 10.0, -179.999), (3, 10.0, 179.9), (4, None, None)], "id int, lat double, lon double")
    places = spark.createDataFrame([(10.0, -179.9995)], "lat double, lon double")
    got = {r.id: r.hit for r in near_any(points, places, 500.0, "hit").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
