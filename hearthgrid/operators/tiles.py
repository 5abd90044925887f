"""Web-Mercator tiles: points by tile index, boxes by overlap, contours of a run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions.geo import mercator_tile


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """(min_lon, min_lat, max_lon, max_lat) of a tile."""
    n = 2 ** z

    def lat(row: float) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1.0 - 2.0 * row / n))))

    return (x / n * 360.0 - 180.0, lat(y + 1), (x + 1) / n * 360.0 - 180.0, lat(y))


def points_in_tile(points: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """Points of one tile with local coordinates. The box range goes first: it can prune the scan."""
    west, south, east, north = tile_bounds(z, x, y)
    margin = 1e-9
    boxed = points.where(F.col("lon").between(west - margin, east + margin) & F.col("lat").between(south - margin, north + margin))
    return boxed.withColumns(mercator_tile("lat", "lon", z)).where((F.col("tile_x") == x) & (F.col("tile_y") == y))


def boxes_in_tile(boxes: DataFrame, z: int, x: int, y: int) -> DataFrame:
    west, south, east, north = tile_bounds(z, x, y)
    return boxes.where((F.col("max_lon") >= west) & (F.col("min_lon") <= east) & (F.col("max_lat") >= south) & (F.col("min_lat") <= north))


def contours_of_run(contours: DataFrame, ledger: DataFrame, run_id: int | None = None) -> DataFrame:
    """Contours of the given run, or of the newest completed one."""
    if run_id is not None:
        return contours.where(F.col("run_id") == run_id)
    newest = ledger.where("status = 'completed'").agg(F.max_by("run_id", F.struct("ref_time", "run_id")).alias("run_id"))
    return contours.join(newest, "run_id", "left_semi")
