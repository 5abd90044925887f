"""Weather tables: normalisation, point look-ups, interpolation and bias statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import scoring
from hearthgrid.operators.neighbours import HOUR_US, micros
from hearthgrid.operators.runs import runs_at_points
from hearthgrid.session import materialize

VARIABLES = ("u10", "v10", "t2m", "rh2m")
#: A raster of up to so many cells, about 45 MB, may be sent to every task.
SENT_CELLS = 500_000


def affine(x: Column, alpha, beta, low: float | None = None, high: float | None = None) -> Column:
    """``alpha + beta * x`` with an optional clamp; alpha and beta may be numbers or columns. Null stays null."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    raw = lift(alpha) + lift(beta) * x
    out = raw
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(raw.isNotNull(), out)


def normalize_truth(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename latitude/longitude and the foreign variable names."""
    return df.withColumnsRenamed({"latitude": "lat", "longitude": "lon", **names})


def nearest_node(coord: str, origin: float, step: float, count: int) -> Column:
    """Index of the nearest grid node (ties go up), clamped to the grid."""
    return F.expr(f"least(greatest(floor(({coord} - {origin!r}D) / {step!r}D + 5e-1), 0), {count - 1})")


def with_ground(df: DataFrame, raster: DataFrame, first: tuple[float, float], step: float, count: int, sent_cells: int = SENT_CELLS) -> DataFrame:
    """Rows (lat, lon) with the columns of the nearest raster cell (i, j) as (ei, ej); rows without one are dropped.

    The raster is written and counted, as rows made by exploding look as few as what they are made of: a small one is sent to every
    task, a large one is merged. The rows themselves, many for each cell, are never what is sent.
    """
    ground = materialize(raster.withColumnsRenamed({"i": "ei", "j": "ej"}), "ground-cells")
    ground = F.broadcast(ground) if ground.count() <= sent_cells else ground.hint("merge")
    near = {"ei": nearest_node("lat", first[0], step, count), "ej": nearest_node("lon", first[1], step, count)}
    return df.withColumns(near).join(ground, ["ei", "ej"])


def pack_series(cells: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per (run, node) with its short time series; its length is the number of forecast steps."""
    step = F.struct(micros(F.col("valid_time")).alias("at"), *variables)
    return cells.groupBy("run_id", "i", "j").agg(F.sort_array(F.collect_list(step)).alias("steps"))


def nearest_step(steps: str, at: str) -> Column:
    """The step nearest in time; of two equally near ones the later."""
    return F.expr(
        f"array_min(transform({steps}, s -> named_struct('gap', abs(s.at - {at}), 'late', -s.at, 'step', s))).step"
    )


def weather_at_points(points: DataFrame, runs: DataFrame, cells: DataFrame, grid: tuple[float, float, float, int],
                      tolerance_h: int = 6, lookback_h: int = 72) -> DataFrame:
    """id, run_id, rh2m, wind_ms, precip_mm of the as-of run at the nearest node and time.

    ``points``: id, lat, lon, t_us. ``grid``: origin_lat, origin_lon, step, nodes per side. Precipitation
    is the sum of the run's own steps in ``[t - lookback, t]``: no step gives null, all-null steps give 0.
    """
    lat0, lon0, step, count = grid
    chosen = materialize(runs_at_points(points.select("id", "lat", "lon", "t_us"), runs, tolerance_h).withColumns({
        "i": nearest_node("lat", lat0, step, count), "j": nearest_node("lon", lon0, step, count)}), "chosen-runs")
    # Of all stored weather only the runs and nodes that points have chosen are packed. Their list is written, so that joins know
    # its size; runs are told apart first, so that cells of the others are dropped where they are read, not dealt out.
    wanted = materialize(chosen.select("run_id", "i", "j").distinct(), "chosen-nodes")
    stored = cells.join(wanted.select("run_id").distinct(), "run_id", "left_semi").join(wanted, ["run_id", "i", "j"], "left_semi")
    packed = pack_series(stored, ["u10", "v10", "rh2m", "tp"])
    met = chosen.join(packed, ["run_id", "i", "j"])
    met = met.withColumn("near", nearest_step("steps", "t_us")).withColumn(
        "past", F.expr(f"filter(steps, s -> s.at BETWEEN t_us - {lookback_h * HOUR_US} AND t_us)"))
    return met.select(
        "id", "run_id",
        F.col("near.rh2m").alias("rh2m"),
        scoring.wind_speed(F.col("near.u10"), F.col("near.v10")).alias("wind_ms"),
        F.expr("CASE WHEN size(past) > 0 THEN aggregate(past, 0e0, (a, s) -> a + coalesce(s.tp, 0e0)) * 1000e0 END").alias("precip_mm"),
    )


def field_stats(cells: DataFrame, variables: Sequence[str] = VARIABLES, keys: Sequence[str] = ()) -> DataFrame:
    """(variable, low, high, mean, n) over non-missing values: one pass, then one small unpivot."""
    good = {v: F.nullif(F.col(v), F.lit(float("nan"))) for v in variables}
    per = [F.struct(F.lit(v).alias("variable"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.count(c).alias("n")).alias(v)
           for v, c in good.items()]
    grouped = cells.groupBy(*keys).agg(*per) if keys else cells.agg(*per)
    return grouped.select(*keys, F.inline(F.array(*variables)))


def interpolate_cube(nodes: DataFrame, targets: DataFrame, variables: Sequence[str], axes: dict[str, tuple[str, float, float, int]],
                     keys: Sequence[str]) -> DataFrame:
    """Linear interpolation in time, latitude and longitude onto target rows; null outside the node range.

    ``axes``: node index column -> (target column, first value, step, count). Every node is sent to the
    eight cells it is a corner of, corners are pivoted once per cell, and a target needs one equi-join.
    """
    names = list(axes)
    corners = F.array(*[
        F.struct(*[(F.col(n) - F.lit(d)).cast("long").alias(f"b_{n}") for n, d in zip(names, (a, b, c))], F.lit(a * 4 + b * 2 + c).alias("corner"))
        for a in (0, 1) for b in (0, 1) for c in (0, 1)
    ])
    base = [f"b_{n}" for n in names]
    cubes = (
        nodes.select(*keys, *variables, F.explode(corners).alias("q")).select(*keys, "q.*", *variables)
        .groupBy(*keys, *base).agg(*[F.max(F.when(F.col("corner") == n, F.col(v))).alias(f"c{n}_{v}") for n in range(8) for v in variables])
    )
    placed = targets
    for n, (column, first, step, count) in axes.items():
        placed = placed.withColumn(f"f_{n}", F.expr(f"({column} - {first!r}D) / {step!r}D"))
        placed = placed.withColumn(f"b_{n}", F.expr(f"CAST(least(floor(f_{n}), {count - 2}) AS BIGINT)"))
    # Merged: corners are made of few nodes or runs, so they look small enough to be sent to every task, and are not.
    met = placed.join(cubes.hint("merge"), [*keys, *base], "left")
    inside = " AND ".join(f"f_{n} BETWEEN 0 AND {count - 1}" for n, (_, _, _, count) in axes.items())

    def side(n: str, high: bool) -> str:
        return f"(f_{n} - b_{n})" if high else f"(1e0 - (f_{n} - b_{n}))"

    mixes = {
        v: " + ".join(f"c{a * 4 + b * 2 + c}_{v} * {side(names[0], a)} * {side(names[1], b)} * {side(names[2], c)}"
                      for a in (0, 1) for b in (0, 1) for c in (0, 1))
        for v in variables
    }
    return met.selectExpr(*targets.columns, *[f"CASE WHEN {inside} THEN {mix} END AS truth_{v}" for v, mix in mixes.items()])


def _finite_pair(f: str, t: str) -> Column:
    inf = F.lit(float("inf"))
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < inf)
    return ok(f) & ok(t)


def _bias_struct(v: str, column: str, name: str) -> Column:
    d = F.when(_finite_pair(column, f"truth_{v}"), F.col(column) - F.col(f"truth_{v}"))
    return F.struct(F.lit(v).alias("variable"), F.avg(d).alias("bias_mean"), F.stddev_pop(d).alias("bias_std"), F.avg(F.abs(d)).alias("mae"),
                    F.sqrt(F.avg(d * d)).alias("rmse"), F.count(d).alias("n")).alias(name)


def bias_metrics(pairs: DataFrame, variables: Sequence[str], prefix: str = "", keys: Sequence[str] = ()) -> DataFrame:
    """(variable, bias_mean, bias_std, mae, rmse, n) of ``prefix + v`` against ``truth_v``, finite pairs only."""
    per = [_bias_struct(v, f"{prefix}{v}", f"m_{v}") for v in variables]
    grouped = pairs.groupBy(*keys).agg(*per) if keys else pairs.agg(*per)
    return grouped.select(*keys, F.inline(F.array(*[f"m_{v}" for v in variables])))


def mean_bias(pairs: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(*[F.avg(F.col(v) - F.col(f"truth_{v}")).alias(v) for v in variables])


def quadrant(pairs: DataFrame) -> DataFrame:
    """Add NW/NE/SW/SE against the midpoint of the domain."""
    mid = pairs.agg(F.struct(((F.min("lat") + F.max("lat")) / 2).alias("lat"), ((F.min("lon") + F.max("lon")) / 2).alias("lon")).alias("m")).scalar()
    return pairs.withColumn("quadrant", F.concat(
        F.when(F.col("lat") >= mid["lat"], "N").otherwise("S"), F.when(F.col("lon") >= mid["lon"], "E").otherwise("W")))


def elevation_band(z: Column) -> Column:
    """Bands of the bias report; below zero belongs to none."""
    return (F.when(z < 0, F.lit(None)).when(z < 500, "0-500m").when(z < 1000, "500-1000m").when(z < 2000, "1000-2000m")
            .when(z < 3000, "2000-3000m").when(z >= 3000, "3000m+"))


CLAMPED = {"rh2m": (0.0, 100.0)}


def fit_bias(pairs: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row, a struct (alpha, beta, n) per variable: least squares of truth on forecast.

    No finite pair gives the identity, a constant forecast gives the mean of the truth.
    """
    per = []
    for v in variables:
        ok = _finite_pair(v, f"truth_{v}")
        x, y = F.when(ok, F.col(v)), F.when(ok, F.col(f"truth_{v}"))
        flat = F.var_pop(x) < 1e-18
        alpha = F.when(F.count(x) == 0, 0.0).when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x))
        beta = F.when(F.count(x) == 0, 1.0).when(flat, 0.0).otherwise(F.regr_slope(y, x))
        per.append(F.struct(alpha.alias("alpha"), beta.alias("beta"), F.count(x).alias("n")).alias(v))
    return pairs.agg(*per)


def apply_bias(df: DataFrame, fit: DataFrame, variables: Sequence[str], prefix: str = "corr_") -> DataFrame:
    """Add corrected columns from the one-row fit."""
    k = fit.select(F.struct(*variables).alias("k")).scalar()
    return df.withColumns({f"{prefix}{v}": affine(F.col(v), k[v]["alpha"], k[v]["beta"], *CLAMPED.get(v, (None, None))) for v in variables})


def improvements(pairs: DataFrame, variables: Sequence[str], prefix: str = "corr_") -> DataFrame:
    """Raw against corrected metrics and their reductions, per variable, in one pass over the pairs."""
    row = pairs.agg(*[_bias_struct(v, v, f"r_{v}") for v in variables], *[_bias_struct(v, f"{prefix}{v}", f"c_{v}") for v in variables])
    listed = row.select(F.explode(F.array(*[F.struct(F.col(f"r_{v}").alias("r"), F.col(f"c_{v}").alias("c")) for v in variables])).alias("x"))
    both = listed.select(F.col("x.r.variable").alias("variable"), *[F.col(f"x.{s}.{c}").alias(f"{name}_{c}") for s, name in (("r", "raw"), ("c", "corr"))
                                                                  for c in ("bias_mean", "bias_std", "mae", "rmse", "n")])
    return both.withColumns({
        "bias_mean_abs_reduction": F.abs("raw_bias_mean") - F.abs("corr_bias_mean"),
        "mae_reduction": F.col("raw_mae") - F.col("corr_mae"), "rmse_reduction": F.col("raw_rmse") - F.col("corr_rmse")})
