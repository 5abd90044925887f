"""Analysis grid: index and centre arithmetic as Column expressions.

A grid is given by its south-west cell *edges*. Cell (i, j) covers
``[origin + i*cell, origin + (i+1)*cell)``, so a point on the upper edge of the extent is outside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    cell: float
    origin_lat: float
    origin_lon: float
    n_lat: int
    n_lon: int
    crs: str = "EPSG:4326"

    @staticmethod
    def from_bbox(min_lon: float, min_lat: float, max_lon: float, max_lat: float, cell: float) -> "GridSpec":
        """Smallest snapped grid that holds the box."""
        if not (min_lon < max_lon and min_lat < max_lat):
            raise ValueError("bbox must have min < max on both axes")
        if not cell > 0:
            raise ValueError("cell size must be positive")
        lat0, lon0 = math.floor(min_lat / cell), math.floor(min_lon / cell)
        lat1, lon1 = math.ceil(max_lat / cell), math.ceil(max_lon / cell)
        return GridSpec(cell, lat0 * cell, lon0 * cell, lat1 - lat0, lon1 - lon0)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return (
            self.origin_lon,
            self.origin_lat,
            self.origin_lon + self.n_lon * self.cell,
            self.origin_lat + self.n_lat * self.cell,
        )

    def metadata(self) -> dict:
        return {
            "crs": self.crs,
            "cell_size_deg": self.cell,
            "origin_lat": self.origin_lat,
            "origin_lon": self.origin_lon,
            "n_lat": self.n_lat,
            "n_lon": self.n_lon,
        }

    def row(self, lat: Column) -> Column:
        return F.floor((lat - F.lit(self.origin_lat)) / F.lit(self.cell))

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.origin_lon)) / F.lit(self.cell))

    def lat_centre(self, i: Column) -> Column:
        return F.lit(self.origin_lat) + (i + F.lit(0.5)) * F.lit(self.cell)

    def lon_centre(self, j: Column) -> Column:
        return F.lit(self.origin_lon) + (j + F.lit(0.5)) * F.lit(self.cell)

    def in_bounds(self, i: Column, j: Column) -> Column:
        return (i >= 0) & (i < self.n_lat) & (j >= 0) & (j < self.n_lon)

    def window(self, min_lon: float, min_lat: float, max_lon: float, max_lat: float, clip: bool = True) -> "GridWindow":
        """Half-open index window that holds the box: floor on the low edge, ceil on the high edge."""
        i0 = math.floor((min_lat - self.origin_lat) / self.cell)
        i1 = math.ceil((max_lat - self.origin_lat) / self.cell)
        j0 = math.floor((min_lon - self.origin_lon) / self.cell)
        j1 = math.ceil((max_lon - self.origin_lon) / self.cell)
        if clip:
            i0, i1 = max(0, min(i0, self.n_lat)), max(0, min(i1, self.n_lat))
            j0, j1 = max(0, min(j0, self.n_lon)), max(0, min(j1, self.n_lon))
        return GridWindow(i0, max(i0, i1), j0, max(j0, j1))

    def cells(self, spark: SparkSession, window: "GridWindow | None" = None) -> DataFrame:
        """All cells of the grid (or a window of it), generated in parallel."""
        w = window or GridWindow(0, self.n_lat, 0, self.n_lon)
        width = max(w.j1 - w.j0, 1)
        total = (w.i1 - w.i0) * (w.j1 - w.j0)
        return spark.range(total).select(
            (F.lit(w.i0) + F.floor(F.col("id") / width)).cast("long").alias("i"),
            (F.lit(w.j0) + F.col("id") % width).cast("long").alias("j"),
        )


@dataclass(frozen=True)
class GridWindow:
    i0: int
    i1: int
    j0: int
    j1: int

    def contains(self, i: Column, j: Column) -> Column:
        return (i >= self.i0) & (i < self.i1) & (j >= self.j0) & (j < self.j1)


def with_cell(df: DataFrame, grid: GridSpec, lat: str = "lat", lon: str = "lon", normalize: bool = True,
              drop_outside: bool = False) -> DataFrame:
    """Add ``i``, ``j`` and ``in_bounds`` for each point."""
    lon_col = normalize_lon(F.col(lon)) if normalize else F.col(lon)
    out = df.withColumns({"i": grid.row(F.col(lat)), "j": grid.col(lon_col)})
    out = out.withColumn("in_bounds", grid.in_bounds(F.col("i"), F.col("j")))
    return out.where("in_bounds") if drop_outside else out


def normalize_lon(lon: Column) -> Column:
    """Wrap to [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
