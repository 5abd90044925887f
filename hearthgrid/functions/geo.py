"""Distances and spherical helpers as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean earth radius, and the series for metres per degree on the WGS84 ellipsoid:
# latitude a0 + a2 cos(2 phi) + a4 cos(4 phi), longitude b1 cos(phi) + b3 cos(3 phi) + b5 cos(5 phi).
EARTH_RADIUS_M = 6371008.8
LAT_SERIES = (111132.954, -559.822, 1.175)
LON_SERIES = (111412.84, -93.5, 0.118)

# Safe bounds of those series.
MIN_M_PER_DEG_LAT, MAX_M_PER_DEG_LAT = 110574.0, 111695.0
MIN_M_PER_DEG_LON_EQ, MAX_M_PER_DEG_LON_EQ = 111319.0, 111695.0


def lon_delta(a: str, b: str) -> str:
    """Signed shortest difference b - a in degrees, across the date line if need be."""
    return f"(pmod({b} - {a} + 540e0, 360e0) - 180e0)"


def local_metres_text(lat1: str, lon1: str, lat2: str, lon2: str, delta: str) -> str:
    phi = f"radians(({lat1} + {lat2}) / 2e0)"
    north = f"({LAT_SERIES[0]!r}::D + {LAT_SERIES[1]!r}::D * cos(2e0 * {phi}) + {LAT_SERIES[2]!r}::D * cos(4e0 * {phi}))"
    east = f"({LON_SERIES[0]!r}::D * cos({phi}) + {LON_SERIES[1]!r}::D * cos(3e0 * {phi}) + {LON_SERIES[2]!r}::D * cos(5e0 * {phi}))"
    return f"sqrt(pow({north} * ({lat2} - {lat1}), 2e0) + pow({east} * {delta}, 2e0))"


def local_metres(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Ellipsoidal distance for nearby points, from metres per degree at the mid latitude.

    Arguments are SQL text: one parsed expression is cheaper to build than a tree of Column calls.
    """
    return F.expr(local_metres_text(lat1, lon1, lat2, lon2, lon_delta(lon1, lon2)).replace("::D", "D"))


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    dphi = f"(radians({lat2} - {lat1}) / 2e0)"
    dlam = f"(radians({lon2} - {lon1}) / 2e0)"
    h = f"(sin({dphi}) * sin({dphi}) + cos(radians({lat1})) * cos(radians({lat2})) * sin({dlam}) * sin({dlam}))"
    return F.expr(f"{2.0 * EARTH_RADIUS_M / 1000.0!r}D * asin(sqrt(least(1e0, {h})))")


class DistanceCells:
    """Cells two radii wide, so a disc always fits into a 2x2 block of them.

    Rows are latitude bands. Every band has its own number of columns, so a column spans at least two
    radii at the worst latitude of the band and its neighbours, also near the poles and across the
    date line. Arguments are SQL text over the columns of the frame.
    """

    def __init__(self, radius_m: float):
        self.radius_m = float(radius_m)
        self.height = 2.0 * radius_m * 1.001 / MIN_M_PER_DEG_LAT

    def _row(self, lat: str, parts: int = 1) -> str:
        return f"floor(({lat} + 90e0) / {self.height / parts!r}D)"

    def _columns_in(self, row: str) -> str:
        h = f"{self.height!r}D"
        worst = f"least(90e0, greatest(abs(({row} - 1) * {h} - 90e0), abs(({row} + 2) * {h} - 90e0)))"
        per_degree = f"({MIN_M_PER_DEG_LON_EQ!r}D * greatest(cos(radians({worst})), 1e-9))"
        return f"CAST(greatest(1, floor({180.0 / (self.radius_m * 1.001)!r}D * {per_degree})) AS BIGINT)"

    def add_home(self, df: DataFrame) -> DataFrame:
        """Add cell_row, cell_col and ``cells_in_row`` from lat and lon."""
        df = df.withColumn("cell_row", F.expr(self._row("lat")))
        df = df.withColumn("cells_in_row", F.expr(self._columns_in("cell_row")))
        return df.withColumn("cell_col", F.expr("pmod(floor((lon + 180e0) / (360e0 / cells_in_row)), cells_in_row)"))

    def explode_cover(self, df: DataFrame) -> DataFrame:
        """One row per cell that the disc around (lat, lon) can touch, without repeats."""
        half = f"{self.height / 2.0!r}D"
        rows = df.withColumn("cell_row", F.explode(F.expr(
            f"array_distinct(array({self._row(f'lat - {half}')}, {self._row(f'lat + {half}')}))")))
        rows = rows.withColumn("cells_in_row", F.expr(self._columns_in("cell_row")))
        rows = rows.withColumn("at_col", F.expr("(lon + 180e0) / (360e0 / cells_in_row)"))
        return rows.withColumn("cell_col", F.explode(F.expr(
            "array_distinct(array(pmod(floor(at_col - 5e-1), cells_in_row), pmod(floor(at_col + 5e-1), cells_in_row)))"
        ))).drop("at_col", "cells_in_row")

    def sub_cell(self, parts: int) -> tuple[str, str]:
        """Text of the indices of the point's sub-cell when every cell is cut into parts x parts.

        Needs the columns of ``add_home``.
        """
        return (
            self._row("lat", parts),
            f"floor(pmod((lon + 180e0) / (360e0 / cells_in_row), CAST(cells_in_row AS DOUBLE)) * {float(parts)!r}D)",
        )


def mercator_tile(lat: str, lon: str, zoom: int) -> dict[str, Column]:
    """Web-Mercator tile indices and the position inside the tile on a 4096 grid."""
    n = 2 ** zoom
    fx = f"(({lon} + 180e0) / 360e0 * {float(n)!r}D)"
    s = f"sin(radians({lat}))"
    fy = f"((5e-1 - ln((1e0 + {s}) / (1e0 - {s})) / {4.0 * math.pi!r}D) * {float(n)!r}D)"
    x = f"least(greatest(floor({fx}), 0), {n - 1})"
    y = f"least(greatest(floor({fy}), 0), {n - 1})"
    return {
        "tile_x": F.expr(x),
        "tile_y": F.expr(y),
        "px": F.expr(f"floor(({fx} - {x}) * 4096e0)"),
        "py": F.expr(f"floor(({fy} - {y}) * 4096e0)"),
    }
