"""Hindcast events, cases and training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthgrid.grid import GridSpec, with_cell
from hearthgrid.operators.neighbours import HOUR_US, micros
from hearthgrid.operators.ordered import grouped_rank
from hearthgrid.plans.spread import CELL, RUN_STEP, cell_weather, in_windows, run_steps, with_terrain


def group_events(times: DataFrame, keys: Sequence[str], interval_h: int, min_steps: int = 1) -> DataFrame:
    """Split each key's reference times at gaps above 1.5 intervals; drop events with too few steps.

    Times are distinct bucket starts, so a key has at most one row per bucket of the calendar.
    """
    order = Window.partitionBy(*keys).orderBy("ref_time")
    gap_us = int(1.5 * interval_h * HOUR_US)
    us = micros(F.col("ref_time"))
    opened = times.withColumn("_new", F.when(us - F.lag(us).over(order) <= gap_us, 0).otherwise(1))
    numbered = opened.withColumn("event", F.sum("_new").over(order))
    whole = Window.partitionBy(*keys, "event")
    sized = numbered.withColumns({"steps": F.count(F.lit(1)).over(whole), "event_start": F.min("ref_time").over(whole)})
    return sized.where(F.col("steps") >= min_steps).drop("_new", "event", "steps")


def observed_cells(detections: DataFrame, runs: DataFrame, horizons: Sequence[int], grid: GridSpec, margin_h: int = 3) -> DataFrame:
    """Cells with a detection within ``margin_h`` of ref + horizon."""
    ends = run_steps(runs, horizons).selectExpr(
        *RUN_STEP, f"unix_micros(CAST(ref_time AS TIMESTAMP)) + (horizon_h + {margin_h}) * {HOUR_US}L AS end_us")
    seen = in_windows(detections.select("lat", "lon", "acq_time"), ends, 2 * margin_h)
    return with_cell(seen, grid, drop_outside=True).select(*CELL).distinct()


def predicted_and_observed(forecast: DataFrame, observed: DataFrame) -> DataFrame:
    """Sparse pairs: a cell that is neither predicted nor observed is absent (both would be 0)."""
    both = forecast.select(*CELL, F.col("p").alias("y_pred")).join(observed.withColumn("y_obs", F.lit(1.0)), CELL, "full_outer")
    return both.withColumns({"y_pred": F.coalesce("y_pred", F.lit(0.0)), "y_obs": F.coalesce("y_obs", F.lit(0.0))})


def hindcast_cases(forecast: DataFrame, observed: DataFrame, active: DataFrame, runs: DataFrame, interval_h: int,
                   min_event_steps: int = 2, min_active: int = 1) -> DataFrame:
    """Prediction against observation for every case of every event; cases with too few active cells are dropped."""
    enough = active.where("fire > 0").groupBy("run_id").agg(F.count(F.lit(1)).alias("active_t0")).where(F.col("active_t0") >= min_active)
    # One catalogue of reference times; its size is the number of runs.
    events = group_events(runs.join(enough.select("run_id"), "run_id", "left_semi").withColumn("series", F.lit(0)), ["series"], interval_h, min_event_steps).drop("series")
    cells = predicted_and_observed(forecast, observed).join(active.select("run_id", "i", "j", "fire"), ["run_id", "i", "j"], "left")
    return cells.withColumn("fire_t0", F.coalesce("fire", F.lit(0.0))).drop("fire").join(events, "run_id")


def sample_negatives(cells: DataFrame, ratio: float = 5.0, min_negatives: int = 500, seed: int = 42) -> DataFrame:
    """Keep positives and burning negatives of each (run, horizon), and a hash-ordered share of the rest.

    The quota is ratio x positives (or, without positives, max(min_negatives, burning negatives)) minus
    the burning negatives. The order is md5 of the cell identity, so reruns pick the same cells.
    """
    burning = (F.col("label") == 0) & (F.col("fire_t0") > 0)
    quota = cells.groupBy(*RUN_STEP).agg(
        F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(burning).alias("_keep"))
    target = F.when(F.col("_pos") > 0, F.floor(F.col("_pos") * F.lit(float(ratio)))).otherwise(F.greatest(F.lit(min_negatives), F.col("_keep")))
    quota = quota.select(*RUN_STEP, F.greatest(F.lit(0), target - F.col("_keep")).alias("_quota"))
    kept = cells.where((F.col("label") == 1) | burning)
    rest = cells.where(~((F.col("label") == 1) | burning)).withColumn(
        "_h", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in CELL], F.lit(str(seed)))))
    ranked = grouped_rank(rest, RUN_STEP, "_h", "_rank")
    sampled = ranked.join(quota, RUN_STEP).where("_rank <= _quota").drop("_h", "_rank", "_quota")
    return kept.unionByName(sampled)


def labelled_cells(runs: DataFrame, horizons: Sequence[int], active: DataFrame, observed: DataFrame, grid: GridSpec) -> DataFrame:
    """Every cell of the window for every run and horizon with its state now and its label then."""
    rows = F.sequence(F.lit(0).cast("long"), F.lit(grid.n_lat - 1).cast("long"))
    cols = F.sequence(F.lit(0).cast("long"), F.lit(grid.n_lon - 1).cast("long"))
    dense = run_steps(runs, horizons).withColumn("i", F.explode(rows)).withColumn("j", F.explode(cols))
    now = active.select("run_id", "i", "j", "fire")
    then = observed.withColumn("label", F.lit(1))
    return dense.join(now, ["run_id", "i", "j"], "left").join(then, CELL, "left").withColumns({
        "fire_t0": F.coalesce("fire", F.lit(0.0)), "label": F.coalesce("label", F.lit(0))}).drop("fire")


def with_inputs(cells: DataFrame, nodes: DataFrame, terrain: DataFrame, grid: GridSpec, weather_grid: tuple) -> DataFrame:
    """Cells (run, horizon, i, j) with elevation, slope, aspect parts, and wind (calm where there is none), temperature and humidity at the horizon."""
    met = cell_weather(cells, nodes, grid, weather_grid)
    blown = met.withColumn("wind_speed", F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10")))
    return with_terrain(blown, terrain).drop("lat", "lon")
