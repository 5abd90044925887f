"""Spread forecasts: runs, inputs, neighbourhood sums, normalisation."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions.spread import KernelConfig, cell_km, kernel_half, kernel_weight
from hearthgrid.grid import GridSpec, with_cell
from hearthgrid.operators.heatmap import cell_values, noise_weight
from hearthgrid.operators.neighbours import HOUR_US, micros
from hearthgrid.operators.raster import circular_mean
from hearthgrid.operators.runs import covers_box, latest_run_at
from hearthgrid.operators.weather import nearest_node, nearest_step, pack_series
from hearthgrid.session import materialize

CELL = ["run_id", "horizon_h", "i", "j"]
RUN_STEP = ["run_id", "horizon_h"]
#: Edge of a block of kernel sums, in cells, where the kernel is narrower.
LEAST_BLOCK = 64


def reference_runs(detections: DataFrame, every_h: int = 24) -> DataFrame:
    """(run_id, ref_time): the end of every time bucket that has detections."""
    slot = F.floor(micros(F.col("acq_time")) / F.lit(every_h * HOUR_US)) + 1
    return detections.select(slot.alias("run_id")).distinct().withColumn(
        "ref_time", F.timestamp_micros(F.col("run_id") * F.lit(every_h * HOUR_US)).cast("timestamp_ntz"))


def in_windows(detections: DataFrame, windows: DataFrame, width_h: int) -> DataFrame:
    """Pair detections with windows ``[end - width, end]`` they fall into.

    ``windows`` has ``end_us`` and any other columns. Both sides meet in slots of one width, so a
    detection is listed twice at most and never meets windows far away in time.
    """
    width = width_h * HOUR_US
    dets = detections.withColumn("t_us", micros(F.col("acq_time"))).withColumn(
        "slot", F.explode(F.expr(f"array(floor(t_us / {width}), floor(t_us / {width}) + 1)")))
    wins = windows.withColumn("slot", F.expr(f"floor(end_us / {width})"))
    return dets.join(wins, "slot").where(f"t_us BETWEEN end_us - {width} AND end_us").drop("slot", "t_us", "end_us")


def active_cells(detections: DataFrame, runs: DataFrame, grid: GridSpec, lookback_h: int = 24) -> DataFrame:
    """(run_id, i, j, fire): largest noise-weighted value of the look-back window; zero cells are absent."""
    windows = runs.select("run_id", micros(F.col("ref_time")).alias("end_us"))
    seen = in_windows(detections.select("lat", "lon", "acq_time", "denoised_score"), windows, lookback_h)
    cells = cell_values(with_cell(seen, grid, drop_outside=True), "max", noise_weight(), ["run_id"])
    return cells.withColumnRenamed("value", "fire")


def node_weather(runs: DataFrame, weather_runs: DataFrame, cells: DataFrame, grid: GridSpec, horizons: Sequence[int]) -> DataFrame:
    """(run_id, horizon_h, ni, nj, u10, v10, t2m, rh2m): newest run covering the grid, step nearest to ref + horizon."""
    covering = weather_runs.where(covers_box(*[F.lit(edge) for edge in grid.bounds]))
    chosen = latest_run_at(runs.select(F.col("run_id").alias("id"), F.col("ref_time").alias("at")), covering).select(F.col("id").alias("spread_run"), "run_id")
    refs = runs.select(F.col("run_id").alias("spread_run"), micros(F.col("ref_time")).alias("ref_us"))
    wanted = cells.join(chosen.select("run_id").distinct(), "run_id", "left_semi")  # a few of all stored runs
    packed = pack_series(wanted, ["u10", "v10", "t2m", "rh2m"]).withColumnsRenamed({"i": "ni", "j": "nj"})
    steps = packed.join(chosen, "run_id").join(refs, "spread_run").withColumn("horizon_h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    near = steps.withColumn("target_us", F.expr(f"ref_us + horizon_h * {HOUR_US}")).withColumn("s", nearest_step("steps", "target_us"))
    return near.select(F.col("spread_run").alias("run_id"), "horizon_h", "ni", "nj", "s.u10", "s.v10", "s.t2m", "s.rh2m")


def run_steps(runs: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return runs.withColumn("horizon_h", F.explode(F.array(*[F.lit(h) for h in horizons])))


def mean_wind(runs: DataFrame, horizons: Sequence[int], nodes: DataFrame, grid: GridSpec, weather_grid: tuple) -> DataFrame:
    """Window-mean wind per run and horizon; calm where a run has no weather.

    The mean is over grid cells, so every node counts as often as it is the nearest one of a cell.
    """
    lat0, lon0, step, count = weather_grid
    share = (
        grid.cells(runs.sparkSession).withColumns({"lat": grid.lat_centre(F.col("i")), "lon": grid.lon_centre(F.col("j"))})
        .withColumns({"ni": nearest_node("lat", lat0, step, count), "nj": nearest_node("lon", lon0, step, count)})
        .groupBy("ni", "nj").agg(F.count(F.lit(1)).alias("cells"))
    )
    wind = nodes.join(share, ["ni", "nj"]).groupBy(*RUN_STEP).agg(
        (F.sum(F.col("u10") * F.col("cells")) / F.sum("cells")).alias("u"), (F.sum(F.col("v10") * F.col("cells")) / F.sum("cells")).alias("v"))
    return run_steps(runs, horizons).join(wind, RUN_STEP, "left").withColumns({"u": F.coalesce("u", F.lit(0.0)), "v": F.coalesce("v", F.lit(0.0))})


def cell_weather(cells: DataFrame, nodes: DataFrame, grid: GridSpec, weather_grid: tuple) -> DataFrame:
    """Weather at the nearest node of each (run, horizon, cell); wind falls back to calm, the rest stays null."""
    lat0, lon0, step, count = weather_grid
    placed = cells.withColumns({"lat": grid.lat_centre(F.col("i")), "lon": grid.lon_centre(F.col("j"))}).withColumns(
        {"ni": nearest_node("lat", lat0, step, count), "nj": nearest_node("lon", lon0, step, count)})
    met = placed.join(nodes, [*RUN_STEP, "ni", "nj"], "left").drop("ni", "nj")
    return met.withColumns({"u10": F.coalesce("u10", F.lit(0.0)), "v10": F.coalesce("v10", F.lit(0.0))})


def with_terrain(cells: DataFrame, terrain: DataFrame) -> DataFrame:
    """Elevation, slope and aspect parts of each cell; null where there is no terrain."""
    aspect = F.radians("aspect_deg")
    ground = terrain.select("i", "j", F.col("z").alias("elevation_m"), "slope_deg", F.sin(aspect).alias("aspect_sin"), F.cos(aspect).alias("aspect_cos"))
    return cells.join(ground, ["i", "j"], "left")


def spread_inputs(cells: DataFrame, horizons: Sequence[int], nodes: DataFrame, terrain: DataFrame, grid: GridSpec, weather_grid: tuple) -> DataFrame:
    """Model inputs per run, horizon and cell: fire, terrain with aspect parts, weather."""
    met = cell_weather(run_steps(cells, horizons), nodes, grid, weather_grid)
    joined = met.join(terrain.select("i", "j", "z", "slope_deg", "aspect_deg"), ["i", "j"], "left")
    return joined.withColumns({
        "aspect_sin": F.sin(F.radians("aspect_deg")), "aspect_cos": F.cos(F.radians("aspect_deg")),
        "wind_speed": F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10")),
    }).withColumnRenamed("z", "elevation_m")


def window_slope(terrain: DataFrame) -> DataFrame:
    """One row: mean slope and circular mean aspect of the window, as the upslope bias of a kernel reads them."""
    return terrain.agg(F.avg("slope_deg").alias("slope_deg"), circular_mean(F.col("aspect_deg")).alias("aspect_deg"))


def _block_sums(grid: GridSpec):
    """Adds up one block's kernel windows: a function of its burning cells and its one row of layout and kernel."""

    def run(burning: pa.Table, layout: pa.Table) -> pa.Table:
        row = {c: layout.column(f"of_{c}")[0] for c in (*RUN_STEP, "bi", "bj")} | {c: layout.column(c)[0] for c in ("half", "edge")}
        half, edge = row["half"].as_py(), row["edge"].as_py()
        kernel = layout.column("kernel").combine_chunks().flatten().flatten().to_numpy(zero_copy_only=False).reshape(2 * half + 1, -1)
        i0, j0 = row["bi"].as_py() * edge, row["bj"].as_py() * edge
        i1, j1 = min(i0 + edge, grid.n_lat), min(j0 + edge, grid.n_lon)
        total, reached = np.zeros((i1 - i0, j1 - j0)), np.zeros((i1 - i0, j1 - j0), dtype=bool)
        places = sorted(zip(burning.column("ai").to_pylist(), burning.column("aj").to_pylist()))  # one order of additions
        for ai, aj in places:
            a, b, c, d = max(ai - half, i0), min(ai + half + 1, i1), max(aj - half, j0), min(aj + half + 1, j1)
            total[a - i0:b - i0, c - j0:d - j0] += kernel[a - ai + half:b - ai + half, c - aj + half:d - aj + half]
            reached[a - i0:b - i0, c - j0:d - j0] = True
        i, j = np.nonzero(reached)
        same = lambda c: pa.array(np.full(len(i), row[c].as_py()), row[c].type)
        return pa.table({"run_id": same("run_id"), "horizon_h": same("horizon_h"), "i": pa.array(i + i0), "j": pa.array(j + j0), "p": pa.array(total[i, j])})

    return run


def kernel_sums(active: DataFrame, wind: DataFrame, grid: GridSpec, cfg: KernelConfig = KernelConfig(), terrain: DataFrame | None = None) -> DataFrame:
    """Sum of the decay weights of all active cells around each cell, per run and horizon.

    The window is cut into blocks at least as wide as the kernel. An active cell is listed under the blocks that its
    kernel reaches, four at most, and a block's task adds the kernel up in place, so rows follow the active
    cells going in and the cells reached coming out, never cells times kernel. The kernel of a run and horizon is worked out
    once (the wind is the same for all its cells) and travels once to each of its blocks.
    """
    mean_lat = F.lit(grid.origin_lat + grid.n_lat * grid.cell / 2.0)
    dy, dx = cell_km(grid.cell, mean_lat)
    shaped = wind.withColumn("wind", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).withColumn(
        "half", kernel_half(F.col("horizon_h"), F.col("wind"), dy, dx, cfg).cast("int")).drop("ref_time")
    # A kernel wider than the window has no cell to reach beyond it.
    shaped = shaped.withColumn("half", F.least("half", F.lit(max(grid.n_lat, grid.n_lon) - 1))).withColumn("edge", F.greatest(2 * F.col("half") + 1, F.lit(LEAST_BLOCK)))
    tilted = cfg.slope_bias and terrain is not None
    if tilted:
        slope = window_slope(terrain).select(F.struct("slope_deg", "aspect_deg").alias("ground")).scalar()
        shaped = shaped.withColumns({"slope_deg": slope["slope_deg"], "aspect_deg": slope["aspect_deg"]})
    elif cfg.slope_bias:
        raise ValueError("an upslope bias needs the terrain of the window")
    burning = active.where(F.col("fire") > cfg.fire_threshold).select("run_id", F.col("i").alias("ai"), F.col("j").alias("aj"))
    # Few rows, much work behind each: spread them over all tasks (a fixed count is not merged away again at run time).
    tasks = max(int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")), active.sparkSession.sparkContext.defaultParallelism)
    block = [*RUN_STEP, "bi", "bj"]
    reach = "sequence(CAST(greatest({0} - half, 0) DIV edge AS INT), CAST(least({0} + half, {1}) DIV edge AS INT))"
    listed = burning.join(shaped.select(*RUN_STEP, "half", "edge"), "run_id").withColumn("bi", F.explode(F.expr(reach.format("ai", grid.n_lat - 1)))).withColumn(
        "bj", F.explode(F.expr(reach.format("aj", grid.n_lon - 1)))).select(*block, "ai", "aj")
    offsets = F.sequence(-F.col("half"), F.col("half"))
    weight = lambda di, dj: kernel_weight(di.cast("double"), dj.cast("double"), F.col("horizon_h"), F.col("u"), F.col("v"), dy, dx, cfg,
                                          F.col("slope_deg") if tilted else None, F.col("aspect_deg") if tilted else None)
    kernels = shaped.select(*RUN_STEP, "half", "edge", F.transform(offsets, lambda di: F.transform(offsets, lambda dj: weight(di, dj))).alias("kernel"))
    listed = materialize(listed, "burning-blocks")
    layout = listed.select(*block).distinct().join(kernels, RUN_STEP).select(*[F.col(c).alias(f"of_{c}") for c in block], "half", "edge", "kernel")
    here, there = listed.repartition(tasks, *block), layout.repartition(tasks, *[f"of_{c}" for c in block])
    return here.groupBy(*block).cogroup(there.groupBy(*[f"of_{c}" for c in block])).applyInArrow(_block_sums(grid), "run_id long, horizon_h int, i long, j long, p double")


def normalise_by_max(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Divide by the largest value of each forecast and clip to [0, 1].

    The maximum is a grouped aggregate joined back, not a window, so one large forecast never sits in one task.
    """
    top = cells.groupBy(*keys).agg(F.max(value).alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))
    return cells.join(top, list(keys)).withColumn(value, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_top")


def apply_masks(cells: DataFrame, mask: DataFrame, value: str = "p") -> DataFrame:
    """Zero outside the mask (i, j, valid); cells the mask does not know count as invalid."""
    met = cells.join(mask.select("i", "j", F.col("valid").alias("_ok")), ["i", "j"], "left")
    return met.withColumn(value, F.when(F.coalesce("_ok", F.lit(False)), F.col(value)).otherwise(F.lit(0.0))).drop("_ok")


def heuristic_forecast(active: DataFrame, wind: DataFrame, mask: DataFrame, grid: GridSpec, cfg: KernelConfig = KernelConfig(),
                       terrain: DataFrame | None = None, aoi: DataFrame | None = None) -> DataFrame:
    """Sparse forecast (run_id, horizon_h, i, j, p): sums, then normalised by the maximum, then masked.

    ``mask`` is the validity of the terrain, ``aoi`` a second mask (i, j, valid) of the area asked for.
    """
    # Written: the maximum, the cells and every reader of the forecast would each add the kernels up again.
    sums = materialize(kernel_sums(active, wind, grid, cfg, terrain), "kernel-sums")
    cells = apply_masks(normalise_by_max(sums, RUN_STEP, "p"), mask)
    return cells if aoi is None else apply_masks(cells, aoi)


@dataclass(frozen=True)
class StoredModels:
    """Where the learned forecast finds its models, and its calibration if that is kept elsewhere."""

    model_path: str
    calibrator_path: str | None = None


def learned_forecast(cells: DataFrame, horizons: Sequence[int], mask: DataFrame, aoi: DataFrame | None = None, *, cfg: StoredModels) -> DataFrame:
    """Dense forecast (columns of ``cells`` and ``p``) by stored classifiers, calibrated if they come with a calibration, then masked."""
    from hearthgrid.plans.artifacts import stored_forecast

    scored = apply_masks(stored_forecast(cells, horizons, cfg.model_path, cfg.calibrator_path), mask)
    return scored if aoi is None else apply_masks(scored, aoi)


#: Forecast models by name, with the type of their parameters.
MODELS = {"heuristic_v0": (heuristic_forecast, KernelConfig), "learned_v1": (learned_forecast, StoredModels)}


def model(name: str, params: Mapping[str, Any] | None = None) -> Callable[..., DataFrame]:
    """The forecast model of that name with these parameters; ones it doesn't know are named in a warning and left out."""
    if name not in MODELS:
        raise ValueError(f"unknown spread model: {name} (there are {', '.join(sorted(MODELS))})")
    run, settings = MODELS[name]
    known = {f.name for f in fields(settings)}
    unknown = sorted(set(params or {}) - known)
    if unknown:
        warnings.warn(f"{name}: unknown parameters left out: {', '.join(unknown)}", stacklevel=2)
    return partial(run, cfg=settings(**{k: v for k, v in (params or {}).items() if k in known}))


def horizon_slice(forecast: DataFrame, run_id: int, horizon_h: int) -> DataFrame:
    """Cells of exactly one horizon; an absent horizon is an error, never replaced by the nearest."""
    out = forecast.where((F.col("run_id") == run_id) & (F.col("horizon_h") == horizon_h))
    if out.isEmpty():
        raise ValueError(f"run {run_id} has no horizon {horizon_h}")
    return out
