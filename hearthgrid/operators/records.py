"""Row-wise helpers: allow-listed projection, labels, run alignment, boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.grid import GridSpec

# Columns a caller may ask for.
ALLOWED = (
    "id", "acq_time", "lat", "lon", "frp", "confidence", "confidence_score", "persistence_score", "landcover_score", "weather_score",
    "brightness", "bright_t31", "scan", "track", "sensor", "source", "is_noise", "denoised_score", "false_source_masked", "fire_likelihood",
)


def select_allowed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        raise ValueError("at least one column is needed")
    unknown = sorted(set(columns) - set(ALLOWED))
    if unknown:
        raise ValueError(f"columns not allowed: {', '.join(unknown)}")
    return df.select(*columns)


def label_number(label: Column) -> Column:
    return F.when(label == "POSITIVE", 1).when(label == "NEGATIVE", 0)


def align_run_time(when: Column, horizon_h: Column, cycle_h: int = 6) -> tuple[Column, Column]:
    """Snap back to the model cycle; the horizon grows by the hours lost, rounded up."""
    run = F.date_trunc("hour", when).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.hour(when) % cycle_h)
    lost = F.ceil(F.timestamp_diff("MICROSECOND", run, when) / F.lit(3600e6))
    return run, (horizon_h + lost).cast("long")


def whole_hours(start: Column, end: Column) -> Column:
    return F.timestamp_diff("HOUR", start, end)


def snapped_grid(cell: float) -> list[Column]:
    """Snapped grid of each row's box (min_lon, min_lat, max_lon, max_lat)."""
    c = F.lit(cell)
    low_i, low_j = F.floor(F.col("min_lat") / c), F.floor(F.col("min_lon") / c)
    return [
        F.round(low_i * c, 6).alias("origin_lat"),
        F.round(low_j * c, 6).alias("origin_lon"),
        (F.ceil(F.col("max_lat") / c) - low_i).alias("n_lat"),
        (F.ceil(F.col("max_lon") / c) - low_j).alias("n_lon"),
    ]


def box_window(grid: GridSpec) -> list[Column]:
    """Clipped half-open index window of each row's box."""
    c, lat0, lon0 = F.lit(grid.cell), F.lit(grid.origin_lat), F.lit(grid.origin_lon)

    def clip(x: Column, top: int) -> Column:
        return F.greatest(F.lit(0), F.least(x, F.lit(top))).cast("long")

    return [
        clip(F.floor((F.col("min_lat") - lat0) / c), grid.n_lat).alias("i0"),
        clip(F.ceil((F.col("max_lat") - lat0) / c), grid.n_lat).alias("i1"),
        clip(F.floor((F.col("min_lon") - lon0) / c), grid.n_lon).alias("j0"),
        clip(F.ceil((F.col("max_lon") - lon0) / c), grid.n_lon).alias("j1"),
    ]


def focus_box(lat: Column, lon: Column, half_km: float) -> dict[str, Column]:
    dlat = F.lit(half_km) / F.lit(111.0)
    dlon = F.lit(half_km) / (F.lit(111.0) * F.cos(F.radians(lat)))
    return {"min_lat": lat - dlat, "max_lat": lat + dlat, "min_lon": lon - dlon, "max_lon": lon + dlon}


def row_json(columns: Sequence[str]) -> Column:
    """The whole row as JSON text; NaN becomes null."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in doubles}) if doubles else df
