"""Detections on the analysis grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions.geo import mercator_tile
from hearthgrid.grid import GridSpec, GridWindow, with_cell
from hearthgrid.operators.runs import newest_per


def cell_values(df: DataFrame, mode: str, value: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Aggregate located rows (i, j) to cells: count, presence, sum or max."""
    if mode not in ("count", "presence", "sum", "max"):
        raise ValueError(f"unknown heatmap mode: {mode}")
    if mode in ("sum", "max") and value is None:
        raise ValueError(f"mode {mode} needs a value")
    agg = {
        "count": lambda: F.count(F.lit(1)),
        "presence": lambda: F.max(F.lit(1)),
        "sum": lambda: F.sum(value),
        "max": lambda: F.max(value),
    }[mode]()
    return df.groupBy(*keys, "i", "j").agg(agg.alias("value"))


def heatmap(points: DataFrame, grid: GridSpec, mode: str = "count", value: Column | None = None) -> DataFrame:
    return cell_values(with_cell(points, grid, drop_outside=True), mode, value)


def noise_weight(score: str = "denoised_score") -> Column:
    """The score, or 1 where it is missing or not finite."""
    c = F.col(score)
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c).otherwise(F.lit(1.0))


def window_heatmap(points: DataFrame, grid: GridSpec, window: GridWindow, mode: str = "count", value: Column | None = None) -> DataFrame:
    """Cells of a window with local indices."""
    located = with_cell(points, grid, drop_outside=True).where(window.contains(F.col("i"), F.col("j")))
    cells = cell_values(located, mode, value)
    return cells.select((F.col("i") - window.i0).alias("i_local"), (F.col("j") - window.j0).alias("j_local"), "i", "j", "value")


def dense(cells: DataFrame, grid: GridSpec, window: GridWindow | None = None) -> DataFrame:
    """Zero-filled: every cell of the window appears, also when there is no detection at all."""
    return grid.cells(cells.sparkSession, window).join(cells, ["i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def region_grid(features: DataFrame, dems: DataFrame) -> DataFrame:
    """Grid of each region: newest features row, else newest elevation row."""
    spec = ["cell", "origin_lat", "origin_lon", "n_lat", "n_lon"]
    pick = lambda df, n: newest_per(df.select("region", "created_at", *spec), ["region"], ["created_at"]).select(
        "region", F.struct(*spec).alias(n))
    both = pick(features, "f").join(pick(dems, "d"), "region", "full_outer")
    return both.select("region", F.col("f").isNotNull().alias("from_features"), F.coalesce("f", "d").alias("g")).select("region", "from_features", "g.*")


def tile_features(points: DataFrame, zoom: int) -> DataFrame:
    """Point rows with tile indices and tile-local coordinates: partition or filter on tile_x, tile_y."""
    return points.withColumns(mercator_tile("lat", "lon", zoom))


def time_bucket(when: Column, hours: int) -> Column:
    """Start of the bucket: hour of day modulo the interval is taken off (longer intervals collapse to the day)."""
    return F.date_trunc("hour", when).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.hour(when) % hours)


def busy_times(df: DataFrame, hours: int, at_least: int, keys: Sequence[str] = ()) -> DataFrame:
    return (
        df.groupBy(*keys, time_bucket(F.col("acq_time"), hours).alias("ref_time"))
        .agg(F.count(F.lit(1)).alias("detections")).where(F.col("detections") >= at_least)
    )


def chronic_cells(df: DataFrame, cell_deg: float, days: int) -> DataFrame:
    """Cells seen on at least ``days`` distinct days; rows fold to (cell, day) before they are counted."""
    cell = {"ci": F.floor(F.col("lat") / F.lit(cell_deg)), "cj": F.floor(F.col("lon") / F.lit(cell_deg))}
    daily = df.withColumns(cell).select("ci", "cj", F.to_date("acq_time").alias("day")).distinct()
    return daily.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("days")).where(F.col("days") >= days)
