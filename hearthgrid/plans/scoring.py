"""Scoring of detections in one plan: mask, persistence, land cover, weather, likelihood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import scoring
from hearthgrid.grid import GridSpec
from hearthgrid.operators.neighbours import HOUR_US, Span, attach_counts, micros, neighbour_counts
from hearthgrid.operators.proximity import near_any
from hearthgrid.operators.raster import sample_cell
from hearthgrid.operators.weather import weather_at_points

MASK_RADIUS_M = 500.0
CLUSTER = Span("cluster_size", 750.0, 72 * HOUR_US)


def clusters(detections: DataFrame, span: Span = CLUSTER, history: DataFrame | None = None) -> DataFrame:
    """cluster_size, sensor_count and the sensors around every detection.

    Neighbours come from ``history``, the whole table, which may or may not hold the detections yet; without it,
    from the detections themselves.
    """
    columns = ["id", "lat", "lon", "acq_time", "sensor"]
    if history is None:
        counts = neighbour_counts(detections, [span], group="sensor")
    else:
        known = history.select(*columns).join(detections.select("id"), "id", "left_anti").unionByName(detections.select(*columns))
        counts = neighbour_counts(known, [span], group="sensor", asking=detections)
    counted = attach_counts(detections, counts)
    return counted.withColumn("sensor_count", F.size("members").cast("long")).withColumnRenamed("members", "sensors")


def weather_scores(detections: DataFrame, runs: DataFrame, cells: DataFrame, grid: tuple) -> DataFrame:
    """id and weather score for detections that have weather; the others are absent."""
    points = detections.select("id", "lat", "lon", micros(F.col("acq_time")).alias("t_us"))
    found = weather_at_points(points, runs, cells, grid)
    return found.select("id", scoring.weather_score(F.col("rh2m"), F.col("precip_mm"), F.col("wind_ms")).alias("weather_score"))


def score_steps(history: Callable, industrial: Callable, landcover: Callable, weather: Callable) -> dict[str, tuple[Callable, str]]:
    """Score steps by name, each with the columns it adds: ``step(rows) -> (id, columns)``. The arguments give a step's tables for a batch."""

    def masked(rows):
        return near_any(rows, industrial(rows), MASK_RADIUS_M, "masked").select("id", "masked")

    def persistence(rows):
        counted = clusters(rows, history=history(rows))
        return counted.select("id", scoring.persistence_score(F.col("cluster_size"), F.col("sensor_count")).alias("persistence_score"))

    def cover(rows):
        raster, grid = landcover(rows)
        return sample_cell(rows, raster, grid, "class", "cover_class").select("id", scoring.landcover_score(F.col("cover_class")).alias("landcover_score"))

    def air(rows):
        found = weather_scores(rows, *weather(rows))
        return rows.select("id").join(found, "id", "left").select("id", F.coalesce("weather_score", F.lit(scoring.NEUTRAL)).alias("weather_score"))

    def confidence(rows):
        return rows.select("id", scoring.confidence_norm(F.col("confidence")).alias("confidence_score"))

    return {"confidence": (confidence, "confidence_score double"), "mask": (masked, "masked boolean"), "persistence": (persistence, "persistence_score double"),
            "landcover": (cover, "landcover_score double"), "weather": (air, "weather_score double")}


def composite(scored: DataFrame) -> DataFrame:
    """Likelihood from whatever component scores there are; a missing mask counts as not masked."""
    c = F.col
    parts = (c("confidence_score"), c("persistence_score"), c("landcover_score"), c("weather_score"))
    return scored.withColumn("fire_likelihood", scoring.likelihood(*parts, F.coalesce("masked", F.lit(False))))


def score_detections(detections: DataFrame, industrial: DataFrame, landcover: DataFrame, landcover_grid: GridSpec,
                     runs: DataFrame, weather: DataFrame, weather_grid: tuple, history: DataFrame | None = None) -> DataFrame:
    """Every component score and the composite likelihood for every detection; clusters count neighbours in ``history`` too."""
    rows = detections.select("id", "lat", "lon", "acq_time", "sensor", "confidence")
    masked = near_any(rows, industrial, MASK_RADIUS_M, "masked")
    covered = sample_cell(masked, landcover, landcover_grid, "class", "cover_class")
    counted = clusters(rows, history=history).select("id", "cluster_size", "sensor_count")
    air = weather_scores(rows, runs, weather, weather_grid)
    scored = covered.join(counted, "id").join(air, "id", "left").select(
        "id", "cluster_size", "sensor_count", "masked",
        scoring.confidence_norm(F.col("confidence")).alias("confidence_score"),
        scoring.persistence_score(F.col("cluster_size"), F.col("sensor_count")).alias("persistence_score"),
        scoring.landcover_score(F.col("cover_class")).alias("landcover_score"),
        F.coalesce(F.col("weather_score"), F.lit(scoring.NEUTRAL)).alias("weather_score"),
    )
    c = F.col
    return scored.withColumn("fire_likelihood", scoring.likelihood(
        c("confidence_score"), c("persistence_score"), c("landcover_score"), c("weather_score"), c("masked")))
