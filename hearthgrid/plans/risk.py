"""Risk grid of a box: land cover and weather per cell."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.functions import scoring
from hearthgrid.functions.geojson import box_feature
from hearthgrid.grid import GridSpec
from hearthgrid.operators.raster import sample_cell
from hearthgrid.operators.weather import weather_at_points


@dataclass(frozen=True)
class RiskGrid:
    n_lat: int
    n_lon: int
    size_lat: float
    size_lon: float


def risk_layout(bbox: tuple[float, float, float, float], cell_km: float, max_cells: int | None = None) -> RiskGrid:
    """As many whole cells as the box holds; with ``max_cells`` both axes shrink by the same factor until they fit."""
    min_lon, min_lat, max_lon, max_lat = bbox
    km_per_lon = 111.0 * math.cos(math.radians((min_lat + max_lat) / 2.0))
    per_axis = [max(1, int(extent / (cell_km * (1.0 / km)))) for extent, km in ((max_lat - min_lat, 111.0), (max_lon - min_lon, km_per_lon))]
    if max_cells is not None and per_axis[0] * per_axis[1] > max_cells:
        per_axis = [min(n, max_cells) for n in per_axis]
        shrink = min(1.0, math.sqrt(max_cells / (per_axis[0] * per_axis[1])))
        per_axis = [max(1, int(n * shrink)) for n in per_axis]
    return RiskGrid(per_axis[0], per_axis[1], (max_lat - min_lat) / per_axis[0], (max_lon - min_lon) / per_axis[1])


def risk_grid(spark: SparkSession, bbox: tuple[float, float, float, float], cell_km: float, at: str, landcover: DataFrame, landcover_grid: GridSpec,
              runs: DataFrame, weather: DataFrame, weather_grid: tuple, max_cells: int | None = None) -> DataFrame:
    """Static (land cover) and dynamic (weather) score, risk and level per cell."""
    g = risk_layout(bbox, cell_km, max_cells)
    k = F.col("id")
    cells = spark.range(g.n_lat * g.n_lon).withColumns({"row": F.floor(k / g.n_lon), "col": k % g.n_lon}).withColumns({
        "min_lat": F.lit(bbox[1]) + F.col("row") * F.lit(g.size_lat), "max_lat": F.lit(bbox[1]) + (F.col("row") + 1) * F.lit(g.size_lat),
        "min_lon": F.lit(bbox[0]) + F.col("col") * F.lit(g.size_lon), "max_lon": F.lit(bbox[0]) + (F.col("col") + 1) * F.lit(g.size_lon),
    }).withColumns({"lat": (F.col("min_lat") + F.col("max_lat")) / 2.0, "lon": (F.col("min_lon") + F.col("max_lon")) / 2.0})
    when = F.unix_micros(F.lit(at).cast("timestamp_ntz").cast("timestamp"))
    points = cells.select("id", "lat", "lon", when.alias("t_us"))  # one moment; the merge deals it to all tasks
    air = weather_at_points(points, runs, weather, weather_grid).select(
        "id", scoring.weather_score(F.col("rh2m"), F.col("precip_mm"), F.col("wind_ms")).alias("dynamic"))
    covered = sample_cell(cells, landcover, landcover_grid, "class", "cover").withColumn("static", scoring.landcover_score(F.col("cover")))
    return covered.join(air, "id", "left").withColumn("risk", scoring.risk_score(F.col("static"), F.col("dynamic"))).withColumn(
        "level", scoring.risk_level(F.col("risk"))).drop("cover")


def risk_features(cells: DataFrame) -> DataFrame:
    """GeoJSON feature per cell."""
    c = F.col
    props = [F.round("risk", 3).alias("risk_score"), c("level").alias("risk_level"), F.round("static", 3).alias("static"), F.round("dynamic", 3).alias("dynamic")]
    return cells.select("id", box_feature(c("min_lon"), c("min_lat"), c("max_lon"), c("max_lat"), props).alias("feature"))


def risk_table(cells: DataFrame) -> DataFrame:
    """Flat rows for the CSV export: centroid of the outline, score, level, components."""
    return cells.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("risk", 3).alias("risk_score"), F.col("level").alias("risk_level"),
                        F.round("static", 3).alias("static"), F.round("dynamic", 3).alias("dynamic"))
