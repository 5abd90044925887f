"""Weather fields, terrain rasters, interpolation and bias."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgrid.catalog.ansi import add_cte, with_ctes
from hearthgrid.catalog.projections import COARSE, r6
from hearthgrid.catalog.registry import query
from hearthgrid.operators import raster, terrain, weather
from hearthgrid.plans.training import split_by_time_steps

VARS = ["u10", "v10", "t2m", "rh2m"]
W = with_ctes("weather_cells")
add_cte("newest_terrain", "SELECT region, terrain_id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY created_at DESC, terrain_id DESC) AS rn FROM terrain_meta) WHERE rn = 1", ("terrain_meta",))
add_cte("dem", "SELECT d.* FROM dem_cells d JOIN newest_terrain USING (terrain_id)", ("dem_cells", "newest_terrain"))
add_cte("pairs", "SELECT f.*, t.u10 AS truth_u10, t.v10 AS truth_v10, t.t2m AS truth_t2m, t.rh2m AS truth_rh2m FROM weather_cells f JOIN truth_cells t USING (run_id, lead_h, i, j)", ("weather_cells", "truth_cells"))


def dem(t):
    return terrain.newest_cells(t.dem_cells, t.terrain_meta)


def pairs(t):
    truth = t.truth_cells.select("run_id", "lead_h", "i", "j", *[F.col(v).alias(f"truth_{v}") for v in VARS])
    # Merged: cells made of few runs look small enough to be sent to every task, and are not.
    return t.weather_cells.join(truth.hint("merge"), ["run_id", "lead_h", "i", "j"])


@query("src_weather_cells", W + "SELECT run_id, run_time, valid_time, lead_h, lat, lon, u10, v10, t2m, rh2m, tp FROM weather_cells")
def weather_cells(t):
    from hearthgrid.sources.readers import normalise_weather
    stored = t.weather_cells.select("run_id", "run_time", F.col("valid_time").alias("time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "u10", "v10", "t2m", "rh2m", "tp")
    return normalise_weather(stored).withColumn("lead_h", F.col("lead_h").cast("int"))


@query("agg_field_stats", W + " UNION ALL ".join(f"SELECT '{v}' AS variable, min({v}) AS low, max({v}) AS high, round(avg({v}), 6) AS mean, count({v}) AS n FROM weather_cells" for v in VARS))
def field_stats(t):
    return weather.field_stats(t.weather_cells, VARS).withColumn("mean", r6(F.col("mean")))


@query("join_regrid", with_ctes("weather_cells", extra={
    "g": "SELECT a.i AS gi, b.j AS gj, 40e0 + (a.i + 0.5e0) * 1e0 AS lat, 22e0 + (b.j + 0.5e0) * 1e0 AS lon FROM (SELECT unnest(range(20)) AS i) a, (SELECT unnest(range(20)) AS j) b",
    "q": "SELECT *, (lat - 40e0) / 2e0 AS fi, (lon - 22e0) / 2e0 AS fj FROM g", "b": "SELECT *, least(floor(fi), 9) AS bi, least(floor(fj), 9) AS bj FROM q"}) +
       "SELECT c.run_id, c.lead_h, round(avg(v), 6) AS u10 FROM (SELECT w.run_id, w.lead_h, gi, gj, sum(w.u10 * (1e0 - abs(w.i - fi)) * (1e0 - abs(w.j - fj))) AS v FROM b JOIN weather_cells w ON w.i IN (bi, bi + 1) AND w.j IN (bj, bj + 1) GROUP BY ALL) c GROUP BY 1, 2")
def regrid(t):
    fine = raster.regrid(t.weather_cells, ["run_id", "lead_h"], "u10", (40.0, 22.0), 2.0, (11, 11), (40.5, 22.5), 1.0, (20, 20))
    return fine.groupBy("run_id", "lead_h").agg(r6(F.avg("u10")).alias("u10"))


_ALIGN = with_ctes("weather_cells", "truth_nodes", extra={
    "q": "SELECT *, lead_h / 6e0 AS ft, (lat - 40e0) / 4e0 AS fi, (lon - 22e0) / 4e0 AS fj FROM weather_cells",
    "b": "SELECT *, least(floor(ft), 3) AS bt, least(floor(fi), 4) AS bi, least(floor(fj), 4) AS bj FROM q",
    "al": "SELECT b.run_id, b.lead_h, b.i, b.j, b.u10, b.t2m, sum(n.u10 * (1e0 - abs(n.ti - ft)) * (1e0 - abs(n.i - fi)) * (1e0 - abs(n.j - fj))) AS truth_u10, "
          "sum(n.t2m * (1e0 - abs(n.ti - ft)) * (1e0 - abs(n.i - fi)) * (1e0 - abs(n.j - fj))) AS truth_t2m FROM b JOIN truth_nodes n ON n.run_id = b.run_id AND n.ti IN (bt, bt + 1) AND n.i IN (bi, bi + 1) AND n.j IN (bj, bj + 1) GROUP BY ALL"})


def aligned(t):
    axes = {"ti": ("lead_h", 0.0, 6.0, 5), "i": ("lat", 40.0, 4.0, 6), "j": ("lon", 22.0, 4.0, 6)}
    return weather.interpolate_cube(t.truth_nodes, t.weather_cells, ["u10", "t2m"], axes, ["run_id"])


@query("join_truth_align", _ALIGN + "SELECT run_id, lead_h, i, j, round(truth_u10, 6) AS truth_u10, round(truth_t2m, 6) AS truth_t2m FROM al")
def truth_align(t):
    return aligned(t).select("run_id", "lead_h", "i", "j", r6(F.col("truth_u10")).alias("truth_u10"), r6(F.col("truth_t2m")).alias("truth_t2m"))


P = with_ctes("pairs")


def metrics_sql(v: str, f: str, src: str = "pairs") -> str:
    return (f"SELECT '{v}' AS variable, round(avg({f} - truth_{v}), 6) AS bias_mean, round(stddev_pop({f} - truth_{v}), 6) AS bias_std, round(avg(abs({f} - truth_{v})), 6) AS mae, "
            f"round(sqrt(avg(({f} - truth_{v}) * ({f} - truth_{v}))), 6) AS rmse, count({f} - truth_{v}) AS n FROM {src}")


def rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query("agg_bias_metrics", P + " UNION ALL ".join(metrics_sql(v, v) for v in VARS))
def bias_metrics(t):
    return rounded(weather.bias_metrics(pairs(t), VARS), "bias_mean", "bias_std", "mae", "rmse")


@query("agg_bias_quadrant", P + "SELECT concat(CASE WHEN lat >= 50 THEN 'N' ELSE 'S' END, CASE WHEN lon >= 32 THEN 'E' ELSE 'W' END) AS quadrant, " + ", ".join(f"round(avg({v} - truth_{v}), 6) AS {v}" for v in VARS) + " FROM pairs GROUP BY 1")
def bias_quadrant(t):
    return rounded(weather.mean_bias(weather.quadrant(pairs(t)), VARS, ["quadrant"]), *VARS)


ELEV = "CAST(least(greatest(floor(({c} - {o}) / 0.1e0 + 0.5e0), 0), 199) AS BIGINT)"
add_cte("pair_elev", "SELECT p.*, d.z FROM pairs p JOIN dem d ON d.i = " + ELEV.format(c="p.lat", o="40.05e0") + " AND d.j = " + ELEV.format(c="p.lon", o="22.05e0"), ("pairs", "dem"))
BAND = "CASE WHEN z < 0 THEN NULL WHEN z < 500 THEN '0-500m' WHEN z < 1000 THEN '500-1000m' WHEN z < 2000 THEN '1000-2000m' WHEN z < 3000 THEN '2000-3000m' WHEN z >= 3000 THEN '3000m+' END"


def with_elevation(t, df):
    return weather.with_ground(df, dem(t).select("i", "j", "z"), (40.05, 22.05), 0.1, 200)


add_cte("node_elev", "SELECT n.i AS wi, n.j AS wj, d.z FROM (SELECT DISTINCT i, j, " + ELEV.format(c="lat", o="40.05e0") + " AS ei, " + ELEV.format(c="lon", o="22.05e0") + " AS ej FROM weather_cells) n JOIN dem d ON d.i = n.ei AND d.j = n.ej",
        ("weather_cells", "dem"))


@query("join_elev_bin", with_ctes("weather_cells", "node_elev") + f"SELECT run_id, lead_h, i, j, z, {BAND} AS band FROM weather_cells JOIN node_elev ON wi = i AND wj = j")
def elev_bin(t):
    return with_elevation(t, t.weather_cells).select("run_id", "lead_h", "i", "j", "z", weather.elevation_band(F.col("z")).alias("band"))


@query("agg_bias_elevation", with_ctes("pair_elev") + f"SELECT {BAND} AS band, " + ", ".join(f"round(avg({v} - truth_{v}), 6) AS {v}" for v in VARS) + " FROM pair_elev GROUP BY 1")
def bias_elevation(t):
    banded = with_elevation(t, pairs(t)).withColumn("band", weather.elevation_band(F.col("z")))
    return rounded(weather.mean_bias(banded, VARS, ["band"]), *VARS)


@query("agg_bias_map", P + "SELECT i, j, round(avg(u10 - truth_u10), 6) AS u10, round(avg(t2m - truth_t2m), 6) AS t2m FROM pairs GROUP BY 1, 2")
def bias_map(t):
    return rounded(weather.mean_bias(pairs(t), ["u10", "t2m"], ["i", "j"]), "u10", "t2m")


@query("agg_bias_ts", P + "SELECT valid_time, round(avg(u10 - truth_u10), 6) AS u10, round(avg(t2m - truth_t2m), 6) AS t2m FROM pairs GROUP BY 1")
def bias_ts(t):
    return rounded(weather.mean_bias(pairs(t), ["u10", "t2m"], ["valid_time"]), "u10", "t2m")


def fit_sql(v: str, src: str = "pairs") -> str:
    return (f"SELECT '{v}' AS variable, CASE WHEN count(*) = 0 THEN 0e0 WHEN var_pop({v}) < 1e-18 THEN avg(truth_{v}) ELSE regr_intercept(truth_{v}, {v}) END AS alpha, "
            f"CASE WHEN count(*) = 0 THEN 1e0 WHEN var_pop({v}) < 1e-18 THEN 0e0 ELSE regr_slope(truth_{v}, {v}) END AS beta, count(*) AS n FROM {src}")


@query("job_bias_fit", with_ctes("pairs", extra={"f": " UNION ALL ".join(fit_sql(v) for v in VARS)}) + "SELECT variable, round(alpha, 5) AS alpha, round(beta, 5) AS beta, n FROM f")
def bias_fit(t):
    fit = weather.fit_bias(pairs(t), VARS)
    rows = fit.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), *[F.col(f"{v}.{c}").alias(c) for c in ("alpha", "beta", "n")]) for v in VARS])))
    return rows.withColumns({"alpha": F.round("alpha", 5), "beta": F.round("beta", 5)})


def corrected_sql(src: str) -> dict[str, str]:
    cols = ", ".join(f"(SELECT alpha FROM f WHERE variable = '{v}') + (SELECT beta FROM f WHERE variable = '{v}') * {v} AS raw_{v}" for v in VARS)
    return {"f": " UNION ALL ".join(fit_sql(v, src) for v in VARS), "c0": f"SELECT *, {cols} FROM pairs",
            "c": "SELECT *, raw_u10 AS corr_u10, raw_v10 AS corr_v10, raw_t2m AS corr_t2m, greatest(least(raw_rh2m, 100e0), 0e0) AS corr_rh2m FROM c0"}


def improvement_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{v}' AS variable, round(abs(avg({v} - truth_{v})) - abs(avg(corr_{v} - truth_{v})), 5) AS bias_mean_abs_reduction, round(avg(abs({v} - truth_{v})) - avg(abs(corr_{v} - truth_{v})), 5) AS mae_reduction, "
        f"round(sqrt(avg(({v} - truth_{v}) * ({v} - truth_{v}))) - sqrt(avg((corr_{v} - truth_{v}) * (corr_{v} - truth_{v}))), 5) AS rmse_reduction FROM {src}" for v in VARS)


def _gains(df):
    return df.select("variable", *[F.round(c, 5).alias(c) for c in ("bias_mean_abs_reduction", "mae_reduction", "rmse_reduction")])


@query("agg_bias_improvement", with_ctes("pairs", extra=corrected_sql("pairs")) + improvement_sql("c"))
def bias_improvement(t):
    p = pairs(t)
    return _gains(weather.improvements(weather.apply_bias(p, weather.fit_bias(p, VARS), VARS), VARS))


@query("job_bias_eval", with_ctes("pairs", extra=corrected_sql("pairs")) + " UNION ALL ".join(f"SELECT 'raw' AS kind, * FROM ({metrics_sql(v, v, 'c')})" for v in VARS) + " UNION ALL " +
       " UNION ALL ".join(f"SELECT 'corrected' AS kind, * FROM ({metrics_sql(v, f'corr_{v}', 'c')})" for v in VARS))
def bias_eval(t):
    p = pairs(t)
    both = weather.apply_bias(p, weather.fit_bias(p, VARS), VARS)
    raw = weather.bias_metrics(both, VARS).select(F.lit("raw").alias("kind"), "*")
    return rounded(raw.unionByName(weather.bias_metrics(both, VARS, "corr_").select(F.lit("corrected").alias("kind"), "*")), "bias_mean", "bias_std", "mae", "rmse")


_TRAIN = {"r": "SELECT *, dense_rank() OVER (ORDER BY valid_time) AS rk, (SELECT count(DISTINCT valid_time) FROM pairs) AS nt FROM pairs",
          "tr": "SELECT * FROM r WHERE rk <= floor(nt * 0.7e0)", "va": "SELECT * FROM r WHERE rk > floor(nt * 0.7e0)"}
_TRAIN_SQL = {**_TRAIN, **{k: (v.replace("FROM pairs", "FROM va") if k == "c0" else v) for k, v in corrected_sql("tr").items()}}


@query("job_bias_train", with_ctes("pairs", extra=_TRAIN_SQL) + improvement_sql("c"))
def bias_train(t):
    split = split_by_time_steps(pairs(t), "valid_time", 0.7)
    fit = weather.fit_bias(split.where("part = 'train'"), VARS)
    return _gains(weather.improvements(weather.apply_bias(split.where("part = 'validation'"), fit, VARS), VARS))


# Terrain

SLOPE = {
    "n": "SELECT *, lag(z) OVER r AS s, lead(z) OVER r AS n, lag(i) OVER r IS NOT NULL AS s_in, lead(i) OVER r IS NOT NULL AS n_in, lag(z) OVER c AS w, lead(z) OVER c AS e, lag(j) OVER c IS NOT NULL AS w_in, lead(j) OVER c IS NOT NULL AS e_in "
         "FROM dem_cells WINDOW r AS (PARTITION BY terrain_id, j ORDER BY i), c AS (PARTITION BY terrain_id, i ORDER BY j)",
    "g": "SELECT terrain_id, i, j, z, CASE WHEN s_in AND n_in THEN (n - s) / 2e0 WHEN n_in THEN n - z WHEN s_in THEN z - s END AS di, CASE WHEN w_in AND e_in THEN (e - w) / 2e0 WHEN e_in THEN e - z WHEN w_in THEN z - w END AS dj FROM n",
    "v": "SELECT *, di / 11132e0 AS gn, dj / (111320e0 * cos(radians(40e0 + (i + 0.5e0) * 0.1e0)) * 0.1e0) AS ge FROM g",
    "sl": "SELECT *, CASE WHEN ge IS NOT NULL AND gn IS NOT NULL THEN least(greatest(degrees(atan(sqrt(ge * ge + gn * gn))), 0e0), 90e0) END AS slope_deg, (degrees(atan2(-ge, -gn)) + 360e0) % 360e0 AS turned FROM v",
    "terrain": "SELECT terrain_id, i, j, z, slope_deg, CASE WHEN slope_deg > 1e-9 THEN turned END AS aspect_deg FROM sl",
}


def slopes(t, cells=None):
    return raster.slope_aspect(cells if cells is not None else t.dem_cells, 0.1, COARSE.lat_centre(F.col("i")), ["terrain_id"])


@query("win_gradient", with_ctes("dem_cells", extra=SLOPE) + "SELECT terrain_id, i, j, round(di, 6) AS di, round(dj, 6) AS dj FROM g")
def gradient(t):
    return raster.gradients(t.dem_cells, ["terrain_id"]).select("terrain_id", "i", "j", r6(F.col("d_i")).alias("di"), r6(F.col("d_j")).alias("dj"))


@query("job_slope_aspect", with_ctes("dem_cells", extra=SLOPE) + "SELECT terrain_id, i, j, round(slope_deg, 6) AS slope_deg, round(aspect_deg, 4) AS aspect_deg FROM terrain")
def slope_aspect(t):
    return slopes(t).select("terrain_id", "i", "j", r6(F.col("slope_deg")).alias("slope_deg"), F.round("aspect_deg", 4).alias("aspect_deg"))


@query("agg_dem_stats", with_ctes("dem_cells") + "SELECT terrain_id, round(count(z) / count(*), 6) AS coverage, min(z) AS low, max(z) AS high, round(avg(z), 6) AS mean, count(z) / count(*) < 0.9e0 AS poor_coverage FROM dem_cells GROUP BY 1")
def dem_stats(t):
    return rounded(terrain.stats(t.dem_cells, "z", ["terrain_id"]), "coverage", "mean")


@query("agg_circular_mean", with_ctes("dem_cells", extra=SLOPE) + "SELECT terrain_id, round(CASE WHEN sqrt(s * s + c * c) >= 1e-12 THEN (degrees(atan2(s, c)) + 360e0) % 360e0 END, 4) AS mean_aspect FROM (SELECT terrain_id, avg(sin(radians(aspect_deg))) AS s, avg(cos(radians(aspect_deg))) AS c FROM terrain GROUP BY 1)")
def circular_mean(t):
    return slopes(t).groupBy("terrain_id").agg(F.round(raster.circular_mean(F.col("aspect_deg")), 4).alias("mean_aspect"))


@query("src_raster_window", with_ctes("dem_cells") + "SELECT terrain_id, 199 - (199 - i) AS i, j, z, z IS NOT NULL AS valid FROM dem_cells WHERE i >= 30 AND i < 170 AND j >= 30 AND j < 160")
def raster_window(t):
    north_up = t.dem_cells.select("terrain_id", (F.lit(199) - F.col("i")).alias("row"), "j", F.coalesce("z", F.lit(-9999.0)).alias("z"))
    got = raster.window_cells(north_up, COARSE.window(25.0, 43.0, 38.0, 57.0), row="row", n_lat=200, nodata=-9999.0, value="z")
    return got.select("terrain_id", "i", "j", "z", "valid")


@query("src_terrain_bbox", with_ctes("dem", "dem_cells") + "SELECT i, j, coalesce(d.z, b.z) AS z FROM (SELECT i, j, min(z) AS z FROM dem_cells GROUP BY 1, 2) b LEFT JOIN (SELECT i, j, z FROM dem) d USING (i, j) WHERE i >= 30 AND i < 170 AND j >= 30 AND j < 160")
def terrain_bbox(t):
    box = (25.0, 43.0, 38.0, 57.0)
    regional = terrain.clip(dem(t).select("i", "j", "z"), COARSE, box).select("i", "j", "z")
    base = terrain.clip(t.dem_cells.groupBy("i", "j").agg(F.min("z").alias("z")), COARSE, box)
    return terrain.with_region_fallback(regional, base, "z")


@query("join_bilinear", with_ctes("detections", "dem", extra={
    "q": "SELECT id, (lat - 40.05e0) / 0.1e0 AS fi, (lon - 22.05e0) / 0.1e0 AS fj FROM detections", "b": "SELECT *, least(floor(fi), 198) AS bi, least(floor(fj), 198) AS bj FROM q",
    "x": "SELECT id, fi, fj, sum(z * (1e0 - abs(i - fi)) * (1e0 - abs(j - fj))) AS v, count(z) AS n FROM b JOIN dem ON i IN (bi, bi + 1) AND j IN (bj, bj + 1) GROUP BY ALL"}) +
       "SELECT b.id, round(CASE WHEN n = 4 AND b.fi BETWEEN 0 AND 199 AND b.fj BETWEEN 0 AND 199 THEN v END, 5) AS elevation_m FROM b LEFT JOIN x USING (id)")
def bilinear(t):
    got = raster.bilinear(t.detections.select("id", "lat", "lon"), dem(t), (40.05, 22.05), 0.1, (200, 200), "z", "elevation_m")
    return got.select("id", F.round("elevation_m", 5).alias("elevation_m"))


@query("join_dem_resample", with_ctes("dem_cells", extra={
    "g": "SELECT DISTINCT terrain_id, a.k AS gi, b.k AS gj, region FROM dem_cells, (SELECT unnest(range(10)) AS k) a, (SELECT unnest(range(10)) AS k) b",
    "b": "SELECT *, (0.2e0 * (gi + 0.5e0) - 0.05e0) / 0.1e0 AS fi, (0.2e0 * (gj + 0.5e0) - 0.05e0) / 0.1e0 AS fj FROM g",
    "x": "SELECT b.terrain_id, gi, gj, sum(z * (1e0 - abs(a - fi)) * (1e0 - abs(c.b - fj))) AS v, count(z) AS n FROM b JOIN dem_cells c ON c.terrain_id = b.terrain_id AND a IN (floor(fi + 1e-9), floor(fi + 1e-9) + 1) AND c.b IN (floor(fj + 1e-9), floor(fj + 1e-9) + 1) GROUP BY ALL"}) +
       "SELECT terrain_id, gi AS i, gj AS j, round(CASE WHEN n = 4 THEN v END, 4) AS z FROM x")
def dem_resample(t):
    local = t.dem_cells.select("terrain_id", F.col("a").alias("i"), F.col("b").alias("j"), "z")
    out = raster.regrid(local, ["terrain_id"], "z", (0.05, 0.05), 0.1, (20, 20), (0.1, 0.1), 0.2, (10, 10))
    return out.select("terrain_id", "i", "j", F.round("z", 4).alias("z"))


@query("job_terrain_window", with_ctes("aois", "aoi_edges", "dem_cells", "newest_terrain", extra={
    **SLOPE, "cur": "SELECT * FROM terrain JOIN newest_terrain USING (terrain_id)",
    "w": "SELECT aoi_id, greatest(0, least(floor((min_lat - 40e0) / 0.1e0), 200)) AS i0, greatest(0, least(ceil((max_lat - 40e0) / 0.1e0), 200)) AS i1, greatest(0, least(floor((min_lon - 22e0) / 0.1e0), 200)) AS j0, greatest(0, least(ceil((max_lon - 22e0) / 0.1e0), 200)) AS j1 FROM aois",
    "wc": "SELECT aoi_id, a.i, b.j, 40e0 + (a.i + 0.5e0) * 0.1e0 AS lat, 22e0 + (b.j + 0.5e0) * 0.1e0 AS lon FROM w JOIN (SELECT unnest(range(200)) AS i) a ON a.i >= i0 AND a.i < i1 JOIN (SELECT unnest(range(200)) AS j) b ON b.j >= j0 AND b.j < j1",
    "m": "SELECT wc.aoi_id, wc.i, wc.j, count_if((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS in_area FROM wc JOIN aoi_edges e USING (aoi_id) GROUP BY 1, 2, 3"}) +
       "SELECT m.aoi_id, m.i, m.j, in_area, z, round(slope_deg, 6) AS slope_deg, z IS NOT NULL AND slope_deg IS NOT NULL AS valid FROM m LEFT JOIN cur USING (i, j)")
def terrain_window(t):
    current = slopes(t, dem(t))
    got = terrain.aoi_windows(t.aois, current, COARSE)
    return got.select("aoi_id", "i", "j", "in_area", "z", r6(F.col("slope_deg")).alias("slope_deg"), "valid")

