"""Predicates on detections and rule checks on gridded inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.grid import GridSpec


def in_bbox(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Column:
    """Edges included; plain ranges, so they reach the Parquet scan of stored detections."""
    return F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon)


def in_time(start: str, end: str, column: str = "acq_time") -> Column:
    """Inclusive range; texts without a zone are UTC."""
    return F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def not_true(column: str) -> Column:
    """Keeps false and null."""
    return ~F.col(column).eqNullSafe(True)


def at_least(column: str, threshold: float) -> Column:
    """An unscored row passes."""
    return F.col(column).isNull() | (F.col(column) >= threshold)


def detections_filter(*, bbox=None, start=None, end=None, include_noise=False, include_masked=False,
                      min_confidence=None, min_likelihood=None) -> Column:
    """All optional predicates of the read path in one condition."""
    parts = []
    if bbox is not None:
        parts.append(in_bbox(*bbox))
    if start is not None and end is not None:
        parts.append(in_time(start, end))
    if not include_noise:
        parts.append(not_true("is_noise"))
    if not include_masked:
        parts.append(not_true("false_source_masked"))
    if min_confidence is not None:
        parts.append(at_least("confidence", min_confidence))
    if min_likelihood is not None:
        parts.append(at_least("fire_likelihood", min_likelihood))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def tile_filter(min_confidence: float = 0.0, include_noise: bool = False, min_likelihood: float | None = None) -> Column:
    """The map tile reader never hides masked rows."""
    return detections_filter(include_noise=include_noise, include_masked=True, min_confidence=min_confidence,
                             min_likelihood=min_likelihood)


# Named time/likelihood presets of the map (hours back, minimum likelihood).
PRESETS = {"1h_high": (1, 0.66), "6h_medium": (6, 0.33), "24h_high": (24, 0.66), "24h_all": (24, None)}


def matching_presets(now: str) -> Column:
    """Array of preset names a detection falls into."""
    at = F.lit(now).cast("timestamp_ntz")
    names = []
    for name, (hours, low) in PRESETS.items():
        hit = F.col("acq_time").between(at - F.make_dt_interval(F.lit(0), F.lit(hours)), at)
        if low is not None:
            hit = hit & at_least("fire_likelihood", low)
        names.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*names))


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return out


@dataclass(frozen=True)
class AoiRules:
    """Limits on a stored area of interest."""

    max_vertices: int = 10_000
    max_area_km2: float = 50_000.0


def aoi_reject_reason(kind: Column, vertices: Column, area_km2: Column, rules: AoiRules = AoiRules()) -> Column:
    return (
        F.when(~F.coalesce(kind.isin("Polygon", "MultiPolygon"), F.lit(False)), "geometry_type")
        .when(vertices == 0, "empty")
        .when(vertices > rules.max_vertices, "too_many_vertices")
        .when(area_km2 > rules.max_area_km2, "too_large")
    )


def grid_violations(meta: DataFrame, grid_of: dict[str, Column], key: str, atol: float = 1e-9) -> DataFrame:
    """One row per broken rule of a raster's stored metadata against the expected grid."""
    c = F.col

    def off(a: Column, b: Column, tol: float = atol) -> Column:
        return F.abs(a - b) > tol

    rules = {
        "crs": ~c("crs").eqNullSafe(grid_of["crs"]),
        "rotation": (F.abs(c("rot_x")) >= 1e-12) | (F.abs(c("rot_y")) >= 1e-12),
        "square": off(c("cell_x"), c("cell_y"), 1e-12),
        "cell_size": off(c("cell_x"), grid_of["cell"]),
        "width": c("width") != grid_of["n_lon"],
        "height": c("height") != grid_of["n_lat"],
        "left": off(c("left_edge"), grid_of["origin_lon"]),
        "bottom": off(c("bottom_edge"), grid_of["origin_lat"]),
        "right": off(c("left_edge") + c("width") * c("cell_x"), grid_of["origin_lon"] + grid_of["n_lon"] * grid_of["cell"]),
        "top": off(c("bottom_edge") + c("height") * c("cell_y"), grid_of["origin_lat"] + grid_of["n_lat"] * grid_of["cell"]),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return meta.select(key, F.explode(broken).alias("violation"))


def weather_violations(cells: DataFrame, runs: DataFrame, variables=("u10", "v10", "t2m", "rh2m")) -> DataFrame:
    """Coverage of each run: missing variables, lead span, number of steps, over-long leads."""
    seen = cells.groupBy("run_id").agg(
        F.min("lead_h").alias("lead_min"), F.max("lead_h").alias("lead_max"), F.count_distinct("lead_h").alias("steps"),
        *[F.count(v).alias(f"n_{v}") for v in variables],
    )
    expected_max = F.least(F.col("horizon_hours"), F.lit(72))
    expected_steps = F.floor(F.col("horizon_hours") / F.col("step_hours")) + 1
    tests = [F.when(F.coalesce(F.col(f"n_{v}"), F.lit(0)) == 0, F.lit(f"missing_{v}")) for v in variables]
    tests.append(F.when((F.col("lead_min") > 0) | (F.col("lead_max") < expected_max) | (F.col("steps") < expected_steps), F.lit("coverage")))
    tests.append(F.when(F.col("lead_max") > 72, F.lit("too_long")))
    return runs.join(seen, "run_id", "left").select(
        "run_id", "lead_min", "lead_max", "steps", F.array_join(F.array_compact(F.array(*tests)), ",").alias("violations"))


def window_mismatch(left: DataFrame, right: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Cells only on one side, and shared cells whose coordinates differ (inputs: i, j, lat, lon)."""
    r = right.select("i", "j", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    both = left.join(r, ["i", "j"], "full_outer")
    return both.agg(
        F.count_if(F.col("r_lat").isNull()).alias("only_left"),
        F.count_if(F.col("lat").isNull()).alias("only_right"),
        F.count_if((F.abs(F.col("lat") - F.col("r_lat")) > tolerance) | (F.abs(F.col("lon") - F.col("r_lon")) > tolerance)).alias("moved"),
        F.count_if(F.col("lat").isNotNull() & F.col("r_lat").isNotNull()).alias("shared"),
    )


def forecast_violations(cells: DataFrame, key: str, value: str, horizons: int) -> DataFrame:
    """Range, finiteness and horizon count of each forecast."""
    good = finite(value)
    return cells.groupBy(key).agg(
        F.count_if(~good).alias("non_finite"),
        F.count_if(good & ((F.col(value) < -1e-6) | (F.col(value) > 1.0 + 1e-6))).alias("out_of_range"),
        F.count_distinct("horizon_h").alias("n_horizons"),
    ).withColumn("valid", (F.col("non_finite") == 0) & (F.col("out_of_range") == 0) & (F.col("n_horizons") == horizons))


def grid_columns(grid: GridSpec) -> dict[str, Column]:
    return {"crs": F.lit(grid.crs), "cell": F.lit(grid.cell), "n_lat": F.lit(grid.n_lat), "n_lon": F.lit(grid.n_lon),
            "origin_lat": F.lit(grid.origin_lat), "origin_lon": F.lit(grid.origin_lon)}
