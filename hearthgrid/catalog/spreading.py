"""Spread inputs, forecasts, hindcasts, calibration, contours, tiles and the risk grid."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import functions as F

from hearthgrid.catalog.ansi import add_cte, with_ctes
from hearthgrid.catalog.fields import SLOPE, dem, slopes
from hearthgrid.catalog.neighbours import WGRID
from hearthgrid.catalog.projections import COARSE, LANDCOVER_SQL, LEVEL_SQL, WEATHER_SQL, kernel_sql, r6
from hearthgrid.catalog.registry import query
from hearthgrid.functions.spread import KernelConfig
from hearthgrid.operators import heatmap, tiles
from hearthgrid.operators.metrics import BIN_EDGES
from hearthgrid.plans import calibration, checks, contours, hindcast, risk, spread
from hearthgrid.session import materialize

HORIZONS = (6, 12, 24)
THRESHOLDS = (0.3, 0.5, 0.7)
NODE = "CAST(least(greatest(floor(({c} - {o}) / 2e0 + 0.5e0), 0), 10) AS BIGINT)"

add_cte("spread_runs", "SELECT run_id, make_timestamp(run_id * 86400000000) AS ref_time FROM (SELECT DISTINCT CAST(floor(epoch_us(acq_time) / 86400e6) AS BIGINT) + 1 AS run_id FROM detections)", ("detections",))
add_cte("active", "SELECT run_id, i, j, max(coalesce(denoised_score, 1e0)) AS fire FROM coarse d JOIN spread_runs r ON acq_time BETWEEN ref_time - INTERVAL '24' HOUR AND ref_time GROUP BY 1, 2, 3", ("coarse", "spread_runs"))
add_cte("steps", "SELECT run_id, ref_time, horizon_h FROM spread_runs, (SELECT unnest([6, 12, 24]) AS horizon_h)", ("spread_runs",))
add_cte("spread_weather_run", "SELECT run_id, wrun FROM (SELECT s.run_id, w.run_id AS wrun, row_number() OVER (PARTITION BY s.run_id ORDER BY run_time DESC, w.created_at DESC, w.run_id DESC) AS rn FROM spread_runs s JOIN weather_runs w "
        "ON w.status = 'completed' AND w.run_time <= s.ref_time AND coalesce(min_lon, -180) <= 22 AND coalesce(max_lon, 180) >= 42 AND coalesce(min_lat, -90) <= 40 AND coalesce(max_lat, 90) >= 60) WHERE rn = 1", ("spread_runs", "weather_runs"))
add_cte("nodes", "SELECT run_id, horizon_h, ni, nj, u10, v10, t2m, rh2m FROM (SELECT s.run_id, s.horizon_h, c.i AS ni, c.j AS nj, c.u10, c.v10, c.t2m, c.rh2m, row_number() OVER (PARTITION BY s.run_id, s.horizon_h, c.i, c.j "
        "ORDER BY abs(epoch_us(c.valid_time) - epoch_us(s.ref_time) - horizon_h * 3600000000), c.valid_time DESC) AS rn FROM steps s JOIN spread_weather_run w USING (run_id) JOIN weather_cells c ON c.run_id = w.wrun) WHERE rn = 1",
        ("steps", "spread_weather_run", "weather_cells"))
add_cte("node_share", f"SELECT {NODE.format(c='(40e0 + (i + 0.5e0) * 0.1e0)', o='40e0')} AS ni, {NODE.format(c='(22e0 + (j + 0.5e0) * 0.1e0)', o='22e0')} AS nj, count(*) AS cells FROM (SELECT unnest(range(200)) AS i) a, (SELECT unnest(range(200)) AS j) b GROUP BY 1, 2")
add_cte("wind", "SELECT s.run_id, s.horizon_h, coalesce(u, 0e0) AS u, coalesce(v, 0e0) AS v FROM steps s LEFT JOIN (SELECT run_id, horizon_h, sum(u10 * cells) / sum(cells) AS u, sum(v10 * cells) / sum(cells) AS v FROM nodes JOIN node_share USING (ni, nj) GROUP BY 1, 2) w USING (run_id, horizon_h)",
        ("steps", "nodes", "node_share"))
_DX = "(0.1e0 * (111e0 * cos(radians(50e0))))"
_PX = f"greatest((0.05e0 * horizon_h + sqrt(u * u + v * v) * horizon_h * 0.1e0) / {_DX}, (0.05e0 * horizon_h + sqrt(u * u + v * v) * horizon_h * 0.1e0) / 11.1e0)"
add_cte("shape", f"SELECT *, floor((CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END) / 2) AS half FROM (SELECT *, floor(greatest(7e0, 2e0 * ({_PX} * 3e0) + 1e0)) AS k FROM wind)", ("wind",))
add_cte("sums", f"SELECT run_id, horizon_h, i, j, sum(w) AS p FROM (SELECT a.run_id, s.horizon_h, a.i + d.di AS i, a.j + e.dj AS j, {kernel_sql('di', 'dj', 'horizon_h', 'u', 'v', '11.1e0', _DX)} AS w "
        "FROM active a JOIN shape s USING (run_id) JOIN (SELECT unnest(range(-199, 200)) AS di) d ON abs(di) <= half JOIN (SELECT unnest(range(-199, 200)) AS dj) e ON abs(dj) <= half "
        "WHERE a.fire > 0 AND a.i + di BETWEEN 0 AND 199 AND a.j + dj BETWEEN 0 AND 199) GROUP BY ALL", ("active", "shape"))
for _name, _text in SLOPE.items():
    add_cte(f"cur_{_name}", _text.replace("FROM dem_cells", "FROM dem").replace("FROM n", "FROM cur_n").replace("FROM g", "FROM cur_g").replace("FROM v", "FROM cur_v").replace("FROM sl", "FROM cur_sl"),
            ("dem",) if _name == "n" else (f"cur_{list(SLOPE)[list(SLOPE).index(_name) - 1]}",))
add_cte("forecast", "SELECT run_id, horizon_h, i, j, CASE WHEN t.z IS NOT NULL AND t.slope_deg IS NOT NULL THEN least(greatest(p / max(p) OVER (PARTITION BY run_id, horizon_h), 0e0), 1e0) ELSE 0e0 END AS p FROM sums LEFT JOIN cur_terrain t USING (i, j)", ("sums", "cur_terrain"))


class World:
    """The spread inputs of one data folder, built once per query.

    Runs, terrain and wind are few rows made of whole tables and read at several places, so each is worked out once and written.
    """

    def __init__(self, t, grid=COARSE):
        self.t = t
        self.grid = grid

    @cached_property
    def runs(self):
        return materialize(spread.reference_runs(self.t.detections), "reference-runs")

    @cached_property
    def active(self):
        return spread.active_cells(self.t.detections, self.runs, self.grid)

    @cached_property
    def terrain(self):
        return materialize(slopes(self.t, dem(self.t)).drop("terrain_id"), "terrain")

    @cached_property
    def mask(self):
        return self.terrain.select("i", "j", (F.col("z").isNotNull() & F.col("slope_deg").isNotNull()).alias("valid"))

    def nodes(self):
        return spread.node_weather(self.runs, self.t.weather_runs, self.t.weather_cells, COARSE, HORIZONS)

    @cached_property
    def _wind(self):
        return materialize(spread.mean_wind(self.runs, HORIZONS, self.nodes(), COARSE, WGRID), "wind")

    def wind(self):
        return self._wind

    def forecast(self):
        return spread.model("heuristic_v0")(self.active, self.wind(), self.mask, COARSE)


@query("join_weather_horizon", with_ctes("nodes") + "SELECT * FROM nodes")
def weather_horizon(t):
    return World(t).nodes()


@query("agg_window_wind", with_ctes("wind") + "SELECT run_id, horizon_h, round(u, 6) AS u, round(v, 6) AS v FROM wind")
def window_wind(t):
    return World(t).wind().select("run_id", "horizon_h", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


add_cte("inputs", f"SELECT a.run_id, s.horizon_h, a.i, a.j, fire, coalesce(u10, 0e0) AS u10, coalesce(v10, 0e0) AS v10, t2m, rh2m, z, slope_deg, aspect_deg FROM active a JOIN steps s USING (run_id) LEFT JOIN nodes n ON n.run_id = a.run_id AND n.horizon_h = s.horizon_h "
        f"AND n.ni = {NODE.format(c='(40e0 + (a.i + 0.5e0) * 0.1e0)', o='40e0')} AND n.nj = {NODE.format(c='(22e0 + (a.j + 0.5e0) * 0.1e0)', o='22e0')} LEFT JOIN cur_terrain t ON t.i = a.i AND t.j = a.j", ("active", "steps", "nodes", "cur_terrain"))


@query("job_spread_inputs", with_ctes("inputs") + "SELECT run_id, horizon_h, i, j, fire, u10, v10, t2m, rh2m, z AS elevation_m, round(slope_deg, 6) AS slope_deg, round(sin(radians(aspect_deg)), 5) AS aspect_sin, round(sqrt(u10 * u10 + v10 * v10), 6) AS wind_speed FROM inputs")
def spread_inputs(t):
    w = World(t)
    got = spread.spread_inputs(w.active, HORIZONS, w.nodes(), w.terrain, COARSE, WGRID)
    return got.select("run_id", "horizon_h", "i", "j", "fire", "u10", "v10", "t2m", "rh2m", "elevation_m", r6(F.col("slope_deg")).alias("slope_deg"),
                      F.round("aspect_sin", 5).alias("aspect_sin"), r6(F.col("wind_speed")).alias("wind_speed"))


@query("join_calm_fallback", with_ctes("inputs") + "SELECT run_id, horizon_h, i, j, u10, v10, t2m, rh2m FROM inputs")
def calm_fallback(t):
    w = World(t)
    return spread.cell_weather(spread.run_steps(w.active, HORIZONS), w.nodes(), COARSE, WGRID).select("run_id", "horizon_h", "i", "j", "u10", "v10", "t2m", "rh2m")


@query("job_spread_kernel", with_ctes("forecast") + "SELECT run_id, horizon_h, i, j, round(p, 6) AS p FROM forecast")
def spread_kernel(t):
    return World(t).forecast().select("run_id", "horizon_h", "i", "j", r6(F.col("p")).alias("p"))


# The same forecast with an upslope bias, and only inside a band of rows as area of interest.
_TILT = "CASE WHEN g.slope_deg > 0 AND g.aspect_deg IS NOT NULL THEN 1e0 - least(0.35e0 * least(greatest(g.slope_deg / 30e0, 0e0), 1e0), 0.9e0) * cos(atan2(di * 11.1e0, dj * " + _DX + ") - radians(90e0 - (g.aspect_deg + 180e0) % 360e0)) ELSE 1e0 END"
_EXP = kernel_sql("di", "dj", "horizon_h", "u", "v", "11.1e0", _DX)
_SLOPED = _EXP.replace("exp(-(CASE", "exp(-((CASE", 1).replace(" END) / (0.05e0 * horizon_h", f" END) * ({_TILT})) / (0.05e0 * horizon_h", 1)
add_cte("ground", "SELECT slope_deg, CASE WHEN sqrt(s * s + c * c) >= 1e-12 THEN (degrees(atan2(s, c)) + 360e0) % 360e0 END AS aspect_deg FROM (SELECT avg(slope_deg) AS slope_deg, avg(sin(radians(aspect_deg))) AS s, avg(cos(radians(aspect_deg))) AS c FROM cur_terrain)", ("cur_terrain",))
add_cte("sloped_sums", f"SELECT run_id, horizon_h, i, j, sum(w) AS p FROM (SELECT a.run_id, s.horizon_h, a.i + d.di AS i, a.j + e.dj AS j, {_SLOPED} AS w "
        "FROM active a JOIN shape s USING (run_id) JOIN (SELECT unnest(range(-199, 200)) AS di) d ON abs(di) <= half JOIN (SELECT unnest(range(-199, 200)) AS dj) e ON abs(dj) <= half CROSS JOIN ground g "
        "WHERE a.fire > 0 AND a.i + di BETWEEN 0 AND 199 AND a.j + dj BETWEEN 0 AND 199) GROUP BY ALL", ("active", "shape", "ground"))


@query("job_spread_kernel_slope", with_ctes("sloped_sums") + "SELECT run_id, horizon_h, i, j, round(CASE WHEN t.z IS NOT NULL AND t.slope_deg IS NOT NULL AND i BETWEEN 40 AND 160 THEN least(greatest(p / max(p) OVER (PARTITION BY run_id, horizon_h), 0e0), 1e0) ELSE 0e0 END, 6) AS p "
       "FROM sloped_sums LEFT JOIN cur_terrain t USING (i, j)")
def spread_kernel_slope(t):
    w = World(t)
    aoi = w.mask.select("i", "j", F.col("i").between(40, 160).alias("valid"))
    cells = spread.heuristic_forecast(w.active, w.wind(), w.mask, COARSE, KernelConfig(slope_bias=True), w.terrain, aoi)
    return cells.select("run_id", "horizon_h", "i", "j", r6(F.col("p")).alias("p"))


add_cte("observed", "SELECT DISTINCT s.run_id, s.horizon_h, c.i, c.j FROM steps s JOIN coarse c ON c.acq_time BETWEEN s.ref_time + INTERVAL '1' HOUR * (horizon_h - 3) AND s.ref_time + INTERVAL '1' HOUR * (horizon_h + 3)", ("steps", "coarse"))
add_cte("pred_obs", "SELECT run_id, horizon_h, i, j, coalesce(p, 0e0) AS y_pred, CASE WHEN o.run_id IS NULL THEN 0e0 ELSE 1e0 END AS y_obs FROM forecast FULL JOIN (SELECT *, 1 AS hit FROM observed) o USING (run_id, horizon_h, i, j)", ("forecast", "observed"))


@query("join_pred_obs", with_ctes("forecast", "observed") + "SELECT coalesce(f.run_id, o.run_id) AS run_id, coalesce(f.horizon_h, o.horizon_h) AS horizon_h, coalesce(f.i, o.i) AS i, coalesce(f.j, o.j) AS j, round(coalesce(p, 0e0), 6) AS y_pred, "
       "CASE WHEN o.i IS NULL THEN 0e0 ELSE 1e0 END AS y_obs FROM forecast f FULL JOIN observed o ON f.run_id = o.run_id AND f.horizon_h = o.horizon_h AND f.i = o.i AND f.j = o.j")
def pred_obs(t):
    w = World(t)
    return hindcast.predicted_and_observed(w.forecast(), hindcast.observed_cells(t.detections, w.runs, HORIZONS, COARSE)).withColumn("y_pred", r6(F.col("y_pred")))


_GROUND = "z AS elevation_m, round(slope_deg, 6) AS slope_deg, round(sin(radians(aspect_deg)), 5) AS aspect_sin, round(cos(radians(aspect_deg)), 5) AS aspect_cos"
_AIR = "coalesce(u10, 0e0) AS u10, coalesce(v10, 0e0) AS v10, t2m, rh2m, round(sqrt(coalesce(u10, 0e0) * coalesce(u10, 0e0) + coalesce(v10, 0e0) * coalesce(v10, 0e0)), 6) AS wind_speed"
_AT_NODE = f"n.run_id = {{0}}.run_id AND n.horizon_h = {{0}}.horizon_h AND n.ni = {NODE.format(c='(40e0 + ({0}.i + 0.5e0) * 0.1e0)', o='40e0')} AND n.nj = {NODE.format(c='(22e0 + ({0}.j + 0.5e0) * 0.1e0)', o='22e0')}"


@query("job_hindcast_cases", with_ctes("forecast", "observed", "active", "nodes", "cur_terrain", extra={
    "c": "SELECT coalesce(f.run_id, o.run_id) AS run_id, coalesce(f.horizon_h, o.horizon_h) AS horizon_h, coalesce(f.i, o.i) AS i, coalesce(f.j, o.j) AS j, coalesce(p, 0e0) AS y_pred, CASE WHEN o.i IS NULL THEN 0e0 ELSE 1e0 END AS y_obs "
         "FROM forecast f FULL JOIN observed o ON f.run_id = o.run_id AND f.horizon_h = o.horizon_h AND f.i = o.i AND f.j = o.j",
    "ok": "SELECT run_id FROM active WHERE fire > 0 GROUP BY 1 HAVING count(*) >= 3",
    "g": "SELECT run_id, ref_time, CASE WHEN ref_time - lag(ref_time) OVER (ORDER BY ref_time) <= INTERVAL '36' HOUR THEN 0 ELSE 1 END AS gap FROM spread_runs JOIN ok USING (run_id)",
    "e": "SELECT *, sum(gap) OVER (ORDER BY ref_time) AS ev FROM g", "e2": "SELECT *, count(*) OVER (PARTITION BY ev) AS n, min(ref_time) OVER (PARTITION BY ev) AS event_start FROM e"}) +
       "SELECT event_start, c.run_id, c.horizon_h, count(*) AS cells, round(sum(y_pred), 4) AS predicted, CAST(sum(y_obs) AS BIGINT) AS observed, count_if(a.fire > 0) AS burning, round(avg(t.slope_deg), 5) AS slope_deg, count(t.aspect_deg) AS with_aspect, "
       f"round(avg(coalesce(n.u10, 0e0)), 6) AS u10, round(avg(coalesce(n.v10, 0e0)), 6) AS v10 FROM c JOIN e2 USING (run_id) LEFT JOIN active a ON a.run_id = c.run_id AND a.i = c.i AND a.j = c.j LEFT JOIN nodes n ON {_AT_NODE.format('c')} LEFT JOIN cur_terrain t ON t.i = c.i AND t.j = c.j WHERE e2.n >= 2 GROUP BY 1, 2, 3")
def hindcast_cases(t):
    w = World(t)
    cases = hindcast.hindcast_cases(w.forecast(), hindcast.observed_cells(t.detections, w.runs, HORIZONS, COARSE), w.active, w.runs, 24, 2, 3)
    cases = hindcast.with_inputs(cases, w.nodes(), w.terrain, COARSE, WGRID)
    return cases.groupBy("event_start", "run_id", "horizon_h").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("y_pred"), 4).alias("predicted"),
                                                                  F.sum("y_obs").cast("long").alias("observed"), F.count_if(F.col("fire_t0") > 0).alias("burning"),
                                                                  F.round(F.avg("slope_deg"), 5).alias("slope_deg"), F.count("aspect_sin").alias("with_aspect"),
                                                                  r6(F.avg("u10")).alias("u10"), r6(F.avg("v10")).alias("v10"))


@query("job_hindcast_dataset", with_ctes("steps", "active", "observed", "nodes", "cur_terrain", extra={
    "cells": "SELECT s.run_id, s.horizon_h, a.i, b.j, coalesce(fire, 0e0) AS fire_t0, CASE WHEN o.i IS NULL THEN 0 ELSE 1 END AS label FROM steps s CROSS JOIN (SELECT unnest(range(200)) AS i) a CROSS JOIN (SELECT unnest(range(200)) AS j) b "
             "LEFT JOIN active act ON act.run_id = s.run_id AND act.i = a.i AND act.j = b.j LEFT JOIN observed o ON o.run_id = s.run_id AND o.horizon_h = s.horizon_h AND o.i = a.i AND o.j = b.j",
    "q": "SELECT run_id, horizon_h, count_if(label = 1) AS pos, count_if(label = 0 AND fire_t0 > 0) AS keep FROM cells GROUP BY 1, 2",
    "r": "SELECT c.*, pos, keep, row_number() OVER (PARTITION BY c.run_id, c.horizon_h ORDER BY md5(concat_ws('|', c.run_id, c.horizon_h, c.i, c.j, 42))) AS rk FROM cells c JOIN q USING (run_id, horizon_h) WHERE label = 0 AND fire_t0 = 0",
    "x": "SELECT run_id, horizon_h, i, j, fire_t0, label FROM cells WHERE label = 1 OR fire_t0 > 0 UNION ALL SELECT run_id, horizon_h, i, j, fire_t0, label FROM r WHERE rk <= greatest(0, CASE WHEN pos > 0 THEN pos * 5 ELSE greatest(500, keep) END - keep)"}) +
       f"SELECT x.run_id, x.horizon_h, x.i, x.j, fire_t0, label, {_GROUND}, {_AIR} FROM x LEFT JOIN nodes n ON {_AT_NODE.format('x')} LEFT JOIN cur_terrain t ON t.i = x.i AND t.j = x.j")
def hindcast_dataset(t):
    """The training cells of the forecast grid: label, state now, terrain, weather of the horizon."""
    w = World(t)
    observed = hindcast.observed_cells(t.detections, w.runs, HORIZONS, COARSE)
    cells = hindcast.sample_negatives(hindcast.labelled_cells(w.runs, HORIZONS, w.active, observed, COARSE))
    full = hindcast.with_inputs(cells, w.nodes(), w.terrain, COARSE, WGRID)
    return full.select("run_id", "horizon_h", "i", "j", "fire_t0", "label", "elevation_m", r6(F.col("slope_deg")).alias("slope_deg"), F.round("aspect_sin", 5).alias("aspect_sin"),
                       F.round("aspect_cos", 5).alias("aspect_cos"), "u10", "v10", "t2m", "rh2m", r6(F.col("wind_speed")).alias("wind_speed"))


@query("agg_case_counts", with_ctes("hindcast") + "SELECT case_id, horizon_h, count_if(fire_t0 > 0) AS active_t0, count_if(y_obs > 0) AS positives, count(*) AS cells FROM hindcast GROUP BY 1, 2")
def case_counts(t):
    return t.hindcast.groupBy("case_id", "horizon_h").agg(F.count_if(F.col("fire_t0") > 0).alias("active_t0"), F.count_if(F.col("y_obs") > 0).alias("positives"), F.count(F.lit(1)).alias("cells"))


@query("agg_forecast_minmax", with_ctes("hindcast") + "SELECT case_id, min(y_pred) AS low, max(y_pred) AS high, count(*) AS cells, count_if(fire_t0 > 0) AS active FROM hindcast GROUP BY 1")
def forecast_minmax(t):
    return t.hindcast.groupBy("case_id").agg(F.min("y_pred").alias("low"), F.max("y_pred").alias("high"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col("fire_t0") > 0).alias("active"))


@query("agg_footprint", with_ctes("forecast") + "SELECT run_id, horizon_h, count_if(p > 0.01e0) AS area FROM forecast GROUP BY 1, 2")
def footprint(t):
    return checks.footprint(World(t).forecast(), "run_id", "p")


@query("agg_centroid", with_ctes("forecast", "wind", extra={"c": "SELECT run_id, horizon_h, sum(p * j) / sum(p) - 100 AS dx, sum(p * i) / sum(p) - 100 AS dy FROM forecast WHERE p > 0.05e0 GROUP BY 1, 2"}) +
       "SELECT run_id, horizon_h, round(dx, 4) AS dx, round(dy, 4) AS dy, round((dx * u + dy * v) / (sqrt(u * u + v * v) + 1e-6), 4) AS downwind FROM c JOIN wind USING (run_id, horizon_h)")
def centroid(t):
    w = World(t)
    cells = w.forecast().join(w.wind().select("run_id", "horizon_h", "u", "v"), ["run_id", "horizon_h"])
    got = checks.centroid(cells, ["run_id", "horizon_h"], "p", (100.0, 100.0), ("u", "v"))
    return got.select("run_id", "horizon_h", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "downwind")])


@query("agg_anisotropy", with_ctes("forecast", "wind", extra={
    "m": "SELECT run_id, horizon_h, count(*) AS n, sum(p) AS s, sum(p * p) AS s2, sum(p * (j - 100)) AS sx, sum(p * (i - 100)) AS sy, sum(p * (j - 100) * (j - 100)) AS sxx, sum(p * (i - 100) * (i - 100)) AS syy, sum(p * (j - 100) * (i - 100)) AS sxy FROM forecast WHERE p > 0.05e0 GROUP BY 1, 2 HAVING count(*) >= 2",
    "k": "SELECT *, (sxx - sx * sx / s) / (s - s2 / s) AS cxx, (syy - sy * sy / s) / (s - s2 / s) AS cyy, (sxy - sx * sy / s) / (s - s2 / s) AS cxy FROM m",
    "e": "SELECT *, (cxx + cyy) / 2 + sqrt(pow((cxx - cyy) / 2, 2) + cxy * cxy) AS hi, greatest((cxx + cyy) / 2 - sqrt(pow((cxx - cyy) / 2, 2) + cxy * cxy), 0) AS lo FROM k",
    "a": "SELECT e.*, abs(degrees(atan2(2 * cxy, cxx - cyy) / 2 - atan2(v, u))) % 180 AS off FROM e JOIN wind USING (run_id, horizon_h)"}) +
       "SELECT run_id, horizon_h, CASE WHEN lo < 1e-9 * hi THEN 'inf'::DOUBLE ELSE round(sqrt(hi / lo), 3) END AS anisotropy, round(CASE WHEN off > 90 THEN 180 - off ELSE off END, 2) AS angle_error FROM a")
def anisotropy(t):
    w = World(t)
    cells = w.forecast().join(w.wind().select("run_id", "horizon_h", "u", "v"), ["run_id", "horizon_h"])
    got = checks.anisotropy(cells, ["run_id", "horizon_h"], "p", (100.0, 100.0), ("u", "v"))
    return got.select("run_id", "horizon_h", F.round("anisotropy", 3).alias("anisotropy"), F.round("angle_error", 2).alias("angle_error"))


@query("job_forecast_slice", with_ctes("forecast") + "SELECT i, j, round(p, 6) AS p FROM forecast WHERE run_id = 19738 AND horizon_h = 12")
def forecast_slice(t):
    return spread.horizon_slice(World(t).forecast(), 19738, 12).select("i", "j", r6(F.col("p")).alias("p"))


# Calibration

_BIN = "(" + " + ".join(f"CASE WHEN y_pred >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in BIN_EDGES) + ")"
add_cte("knots", f"SELECT horizon_h, x, max(y) OVER (PARTITION BY horizon_h ORDER BY b) AS y, row_number() OVER (PARTITION BY horizon_h ORDER BY b) AS n FROM (SELECT horizon_h, {_BIN} AS b, avg(y_pred) AS x, avg(y_obs) AS y FROM hindcast GROUP BY 1, 2)", ("hindcast",))
add_cte("calibrated", "SELECT h.*, CASE WHEN lo.n IS NULL THEN (SELECT y FROM knots f WHERE f.horizon_h = h.horizon_h AND f.n = 1) WHEN hi.n IS NULL THEN lo.y ELSE lo.y + (hi.y - lo.y) * (y_pred - lo.x) / (hi.x - lo.x) END AS y_cal "
        "FROM (SELECT *, (SELECT count(*) FROM knots k WHERE k.horizon_h = c.horizon_h AND k.x <= c.y_pred) AS at FROM hindcast c) h LEFT JOIN knots lo ON lo.horizon_h = h.horizon_h AND lo.n = h.at LEFT JOIN knots hi ON hi.horizon_h = h.horizon_h AND hi.n = h.at + 1", ("hindcast", "knots"))


@query("job_calibrate_apply", with_ctes("calibrated") + "SELECT cell_id, horizon_h, round(y_cal, 6) AS y_cal FROM calibrated")
def calibrate_apply(t):
    return calibration.apply_knots(t.hindcast, calibration.binned_knots(t.hindcast)).select("cell_id", "horizon_h", r6(F.col("y_cal")).alias("y_cal"))


@query("job_calibrate_eval", with_ctes("calibrated", extra={
    "er": f"SELECT horizon_h, sum(n * abs(o - m)) / sum(n) AS ece FROM (SELECT horizon_h, {_BIN} AS b, avg(y_pred) AS m, avg(y_obs) AS o, count(*) AS n FROM calibrated GROUP BY 1, 2) GROUP BY 1",
    "ec": f"SELECT horizon_h, sum(n * abs(o - m)) / sum(n) AS ece FROM (SELECT horizon_h, {_BIN.replace('y_pred', 'y_cal')} AS b, avg(y_cal) AS m, avg(y_obs) AS o, count(*) AS n FROM calibrated GROUP BY 1, 2) GROUP BY 1",
    "b": "SELECT horizon_h, avg((y_pred - y_obs) * (y_pred - y_obs)) AS r, avg((y_cal - y_obs) * (y_cal - y_obs)) AS c, count(*) AS n FROM calibrated GROUP BY 1"}) +
       "SELECT horizon_h, round(r, 6) AS brier_raw, round(c, 6) AS brier_cal, round(er.ece, 5) AS ece_raw, round(ec.ece, 5) AS ece_cal, n FROM b JOIN er USING (horizon_h) JOIN ec USING (horizon_h)")
def calibrate_eval(t):
    got = calibration.evaluate(calibration.apply_knots(t.hindcast, calibration.binned_knots(t.hindcast)))
    return got.select("horizon_h", r6(F.col("brier_raw")).alias("brier_raw"), r6(F.col("brier_cal")).alias("brier_cal"), F.round("ece_raw", 5).alias("ece_raw"), F.round("ece_cal", 5).alias("ece_cal"), "n")


# Contours, tiles, risk

_EDGE_PARTS = {
    "th": "SELECT run_id, horizon_h, threshold, i, j FROM forecast, (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS threshold) WHERE p >= threshold",
    "ed": " UNION ALL ".join(f"SELECT run_id, horizon_h, threshold, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM th" for x1, y1, x2, y2 in
                             (("j", "i", "j + 1", "i"), ("j + 1", "i", "j + 1", "i + 1"), ("j + 1", "i + 1", "j", "i + 1"), ("j", "i + 1", "j", "i"))),
    "bd": "SELECT e.* FROM ed e WHERE NOT EXISTS (SELECT 1 FROM ed r WHERE r.run_id = e.run_id AND r.horizon_h = e.horizon_h AND r.threshold = e.threshold AND r.x1 = e.x2 AND r.y1 = e.y2 AND r.x2 = e.x1 AND r.y2 = e.y1)"}


@query("job_contours", with_ctes("forecast", extra=_EDGE_PARTS) + "SELECT run_id, horizon_h, threshold, count(*) AS edges, round((SELECT count(*) FROM th t WHERE t.run_id = b.run_id AND t.horizon_h = b.horizon_h AND t.threshold = b.threshold) * 0.01e0, 6) AS area_deg2, "
       "round(22e0 + min(x1) * 0.1e0, 6) AS min_lon, round(40e0 + min(y1) * 0.1e0, 6) AS min_lat, round(22e0 + max(x1) * 0.1e0, 6) AS max_lon, round(40e0 + max(y1) * 0.1e0, 6) AS max_lat FROM bd b GROUP BY 1, 2, 3")
def job_contours(t):
    s = contours.contour_summary(World(t).forecast(), THRESHOLDS, COARSE)
    return s.select("run_id", "horizon_h", "threshold", "edges", *[r6(F.col(c)).alias(c) for c in ("area_deg2", "min_lon", "min_lat", "max_lon", "max_lat")])


_RING_KEY, _SAME = "run_id, horizon_h, threshold", "{0}.run_id = {1}.run_id AND {0}.horizon_h = {1}.horizon_h AND {0}.threshold = {1}.threshold"


def ring_sql(thresholds, rounds=14):
    """Contour rings as SQL, for rings of up to ``2 ** rounds`` edges: the ``shapes`` of each contour as nested lists of points.

    A hole belongs to the smallest outer ring around the point left of its leftmost edge, by crossings.
    """
    levels = ", ".join(f"{x!r}::DOUBLE" for x in thresholds)
    parts = {k: v.replace("[0.3e0, 0.5e0, 0.7e0]", f"[{levels}]") for k, v in _EDGE_PARTS.items()}
    steps = [f"bn AS MATERIALIZED (SELECT {_RING_KEY}, d, (y1 * 201 + x1) * 4 + d AS id, y2 * 201 + x2 AS c2 FROM (SELECT *, CASE WHEN x2 > x1 THEN 0 WHEN y2 > y1 THEN 1 WHEN x2 < x1 THEN 2 ELSE 3 END AS d FROM bd))",
             f"nx AS MATERIALIZED (SELECT b.run_id, b.horizon_h, b.threshold, b.id, any_value(b.d) AS d, min_by(o.id, CASE o.d WHEN (b.d + 1) % 4 THEN 0 WHEN b.d THEN 1 ELSE 2 END) AS jump FROM bn b JOIN bn o ON {_SAME.format('b', 'o')} AND o.id // 4 = b.c2 GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY b.run_id, b.horizon_h, b.threshold, b.id"),
             f"s0 AS MATERIALIZED (SELECT {_RING_KEY}, id, jump, id AS ring, 0 AS off FROM nx)"]
    for n in range(rounds):
        steps.append(f"s{n + 1} AS MATERIALIZED (SELECT a.run_id, a.horizon_h, a.threshold, a.id, b.jump, least(a.ring, b.ring) AS ring, CASE WHEN b.ring < a.ring THEN b.off + {1 << n} ELSE a.off END AS off FROM s{n} a JOIN s{n} b ON {_SAME.format('a', 'b')} AND b.id = a.jump)")
    steps += [
        f"re AS MATERIALIZED (SELECT {_RING_KEY}, ring, off, nx.jump % 4 <> d AS turns, d, (id // 4) % 201 AS x1, id // 4 // 201 AS y1, (nx.jump // 4) % 201 AS x2, nx.jump // 4 // 201 AS y2 FROM s{rounds} JOIN nx USING ({_RING_KEY}, id))",
        f"rs AS MATERIALIZED (SELECT {_RING_KEY}, ring, sum(x1 * y2 - x2 * y1) / 2 AS cells FROM re GROUP BY ALL)",
        f"rp AS (SELECT {_RING_KEY}, ring, list([22e0 + x2 * 0.1e0, 40e0 + y2 * 0.1e0] ORDER BY CASE off WHEN 1 THEN -2 WHEN 0 THEN -1 ELSE 1000000 - off END) AS pts FROM re WHERE turns GROUP BY ALL)",
        f"hp AS (SELECT {_RING_KEY}, ring, min(x1 * 1000 + y1) AS at FROM re JOIN rs USING ({_RING_KEY}, ring) WHERE cells < 0 AND d = 1 GROUP BY ALL)",
        f"ho AS (SELECT h.run_id, h.horizon_h, h.threshold, h.ring, r.ring AS owner, any_value(r.cells) AS cells FROM hp h JOIN re e ON {_SAME.format('h', 'e')} AND e.d IN (1, 3) AND least(e.y1, e.y2) = h.at % 1000 AND e.x1 < h.at // 1000 JOIN rs r ON {_SAME.format('r', 'e')} AND r.ring = e.ring AND r.cells > 0 "
        "GROUP BY h.run_id, h.horizon_h, h.threshold, h.ring, r.ring HAVING count(*) % 2 = 1)",
        f"ow AS (SELECT {_RING_KEY}, ring, min_by(owner, cells) AS owner FROM ho GROUP BY ALL)",
        f"po AS (SELECT {_RING_KEY}, coalesce(owner, ring) AS owner, list(list_concat(pts, [pts[1]]) ORDER BY cells < 0, ring) AS rings, count(*) - 1 AS holes, sum(len(pts)) AS corners FROM rs JOIN rp USING ({_RING_KEY}, ring) LEFT JOIN ow USING ({_RING_KEY}, ring) GROUP BY {_RING_KEY}, coalesce(owner, ring))",
        f"shapes AS (SELECT {_RING_KEY}, list(rings ORDER BY owner) AS polygons, count(*) AS n, sum(holes) AS holes, sum(corners) AS corners FROM po GROUP BY {_RING_KEY})",
        f"wanted AS (SELECT run_id, horizon_h, threshold FROM steps, (SELECT unnest([{levels}]) AS threshold))"]
    return with_ctes("forecast", "steps", extra=parts).rstrip() + ", " + ", ".join(steps) + " "


@query("snk_contours", ring_sql((0.3, 0.5, 0.99)) + f"SELECT {_RING_KEY}, CAST(coalesce(n, 0) AS BIGINT) AS polygons, CAST(coalesce(holes, 0) AS BIGINT) AS holes, CAST(coalesce(corners, 0) AS BIGINT) AS corners FROM wanted LEFT JOIN shapes USING ({_RING_KEY})")
def sink_contours(t):
    """What the stored GeoJSON of each contour holds."""
    from hearthgrid.sources.sinks import write_contours
    w = World(t)
    levels = (0.3, 0.5, 0.99)
    full = contours.complete_contours(w.runs, HORIZONS, levels, contours.contour_polygons(w.forecast(), levels, COARSE))
    stored = write_contours(full).withColumn("c", F.from_json("feature", "geometry struct<coordinates: array<array<array<array<double>>>>>")["geometry"]["coordinates"])
    polygons, rings = F.size("c").cast("long"), F.flatten("c")
    corners = F.aggregate(rings, F.lit(0).cast("long"), lambda n, ring: n + F.size(ring) - 1)
    return stored.select("run_id", "horizon_h", "threshold", polygons.alias("polygons"), (F.size(rings) - polygons).alias("holes"), corners.alias("corners"))


@query("join_tile", with_ctes("detections", "aois") + "SELECT 'fire' AS layer, id FROM detections WHERE floor((lon + 180e0) / 360e0 * 64e0) = 38 AND floor((0.5e0 - ln((1e0 + sin(radians(lat))) / (1e0 - sin(radians(lat)))) / " f"{4 * math.pi!r}" "::DOUBLE) * 64e0) = 22 "
       "AND (confidence IS NULL OR confidence >= 0) AND is_noise IS NOT TRUE UNION ALL SELECT 'aoi', aoi_id FROM aois WHERE max_lon >= 33.75e0 AND min_lon <= 39.375e0 AND max_lat >= " f"{tiles.tile_bounds(6, 38, 22)[1]!r}::DOUBLE AND min_lat <= {tiles.tile_bounds(6, 38, 22)[3]!r}::DOUBLE")
def join_tile(t):
    from hearthgrid.operators.filters import tile_filter
    fires = tiles.points_in_tile(t.detections.where(tile_filter()), 6, 38, 22).select(F.lit("fire").alias("layer"), "id")
    return fires.unionByName(tiles.boxes_in_tile(t.aois, 6, 38, 22).select(F.lit("aoi").alias("layer"), F.col("aoi_id").alias("id")))


_FX, _FY = "((lon + 180e0) / 360e0 * 1024e0)", f"((0.5e0 - ln((1e0 + sin(radians(lat))) / (1e0 - sin(radians(lat)))) / {4 * math.pi!r}::DOUBLE) * 1024e0)"


@query("agg_tile", with_ctes("detections", extra={"p": f"SELECT CAST(floor({_FX}) AS BIGINT) AS tile_x, CAST(floor({_FY}) AS BIGINT) AS tile_y, CAST(floor(({_FX} - floor({_FX})) * 4096) AS BIGINT) AS px, CAST(floor(({_FY} - floor({_FY})) * 4096) AS BIGINT) AS py "
       "FROM detections WHERE is_noise IS NOT TRUE AND (confidence IS NULL OR confidence >= 0)"}) + "SELECT tile_x, tile_y, count(*) AS features, min(px) AS min_px, max(px) AS max_px, min(py) AS min_py, max(py) AS max_py FROM p GROUP BY 1, 2")
def agg_tile(t):
    from hearthgrid.operators.filters import tile_filter
    rows = heatmap.tile_features(t.detections.where(tile_filter()), 10)
    return rows.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("features"), F.min("px").alias("min_px"), F.max("px").alias("max_px"), F.min("py").alias("min_py"), F.max("py").alias("max_py"))


@query("join_latest_contours", with_ctes("forecast") + "SELECT DISTINCT run_id, horizon_h, threshold FROM forecast, (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS threshold) WHERE p >= threshold AND run_id = (SELECT max(run_id) FROM forecast)")
def latest_contours(t):
    w = World(t)
    rows = contours.contour_summary(w.forecast(), THRESHOLDS, COARSE)
    ledger = w.runs.withColumn("status", F.lit("completed"))
    return tiles.contours_of_run(rows, ledger).select("run_id", "horizon_h", "threshold")


RISK_BOX, RISK_KM, RISK_AT = (24.0, 42.0, 34.0, 52.0), 20.0, "2024-01-12 08:30:00"
_G = risk.risk_layout(RISK_BOX, RISK_KM)
_RISK = {
    "g": f"SELECT a.r * {_G.n_lon} + b.c AS id, 42e0 + a.r * {_G.size_lat!r}::DOUBLE AS min_lat, 42e0 + (a.r + 1) * {_G.size_lat!r}::DOUBLE AS max_lat, 24e0 + b.c * {_G.size_lon!r}::DOUBLE AS min_lon, 24e0 + (b.c + 1) * {_G.size_lon!r}::DOUBLE AS max_lon "
         f"FROM (SELECT unnest(range({_G.n_lat})) AS r) a, (SELECT unnest(range({_G.n_lon})) AS c) b",
    "q": f"SELECT *, (min_lat + max_lat) / 2e0 AS lat, (min_lon + max_lon) / 2e0 AS lon, TIMESTAMP '{RISK_AT}' AS at FROM g",
    "ro": "SELECT id, run_id FROM (SELECT q.id, r.run_id, row_number() OVER (PARTITION BY q.id ORDER BY r.run_time DESC, r.created_at DESC, r.run_id DESC) AS rn FROM q JOIN weather_runs r ON r.status = 'completed' AND r.run_time <= q.at AND r.run_time >= q.at - INTERVAL '6' HOUR "
          "AND coalesce(r.min_lon, -180e0) <= lon AND coalesce(r.max_lon, 180e0) >= lon AND coalesce(r.min_lat, -90e0) <= lat AND coalesce(r.max_lat, 90e0) >= lat) WHERE rn = 1",
    "ai": "SELECT q.id, max_by(c.rh2m, -abs(epoch_us(c.valid_time) - epoch_us(q.at))) AS rh2m, max_by(sqrt(c.u10 * c.u10 + c.v10 * c.v10), -abs(epoch_us(c.valid_time) - epoch_us(q.at))) AS ws, "
          "sum(c.tp) FILTER (WHERE c.valid_time BETWEEN q.at - INTERVAL '72' HOUR AND q.at) * 1000e0 AS pr FROM q JOIN ro USING (id) JOIN weather_cells c ON c.run_id = ro.run_id "
          f"AND c.i = {NODE.format(c='q.lat', o='40e0')} AND c.j = {NODE.format(c='q.lon', o='22e0')} GROUP BY 1",
    "z": f"SELECT q.id, lat, lon, {LANDCOVER_SQL.format(c='class')} AS static, " + WEATHER_SQL.format(rh="rh2m", pr="pr", ws="ws") + " AS dyn, ai.id IS NOT NULL AS air FROM q LEFT JOIN landcover l ON l.i = CAST(floor((lat - 40e0) / 0.1e0) AS BIGINT) AND l.j = CAST(floor((lon - 22e0) / 0.1e0) AS BIGINT) LEFT JOIN ai USING (id)",
    "k": "SELECT *, CASE WHEN air THEN 0.6e0 * static + 0.4e0 * dyn ELSE static END AS risk FROM z",
}


def risk_cells(t):
    return risk.risk_grid(t.spark, RISK_BOX, RISK_KM, RISK_AT, t.landcover, COARSE, t.weather_runs, t.weather_cells, WGRID)


@query("job_risk_grid", with_ctes("weather_runs", "weather_cells", "landcover", extra=_RISK) + f"SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, static, CASE WHEN air THEN round(dyn, 3) END AS dynamic, round(risk, 3) AS risk_score, {LEVEL_SQL.format(s='risk')} AS risk_level FROM k")
def risk_grid(t):
    return risk.risk_table(risk_cells(t))


@query("snk_risk_csv", with_ctes("weather_runs", "weather_cells", "landcover", extra=_RISK) + f"SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, static, CASE WHEN air THEN round(dyn, 3) END AS dynamic, round(risk, 3) AS risk_score, {LEVEL_SQL.format(s='risk')} AS risk_level FROM k")
def risk_csv(t):
    from hearthgrid.sources.sinks import through_csv
    return through_csv(risk.risk_table(risk_cells(t)), "risk")


