"""Sanity checks of spread forecasts as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def footprint(cells: DataFrame, key: str, value: str, threshold: float = 0.01) -> DataFrame:
    """Cells above the threshold per forecast and horizon."""
    return cells.groupBy(key, "horizon_h").agg(F.count_if(F.col(value) > threshold).alias("area"))


def shrinking(areas: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """Steps at which the footprint shrinks by more than the tolerance (one row per horizon and forecast)."""
    order = Window.partitionBy(key).orderBy("horizon_h")
    stepped = areas.withColumns({"next_h": F.lead("horizon_h").over(order), "next_area": F.lead("area").over(order)})
    return stepped.where((F.col("area") > 0) & (F.col("next_area") < F.col("area") * (1.0 - tolerance))).select(
        key, "horizon_h", "next_h", "area", "next_area")


def centroid(cells: DataFrame, keys: list[str], value: str, centre: tuple[float, float], wind: tuple[str, str], floor: float = 0.05) -> DataFrame:
    """Probability-weighted centre relative to the window centre, and its component along the wind."""
    w = F.when(F.col(value) > floor, F.col(value))
    u, v = wind
    sums = cells.groupBy(*keys).agg((F.sum(w * F.col("j")) / F.sum(w)).alias("x"), (F.sum(w * F.col("i")) / F.sum(w)).alias("y"), F.max(u).alias("u"), F.max(v).alias("v"))
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    dx, dy = F.col("x") - F.lit(centre[1]), F.col("y") - F.lit(centre[0])
    return sums.select(*keys, dx.alias("dx"), dy.alias("dy"), ((dx * F.col("u") + dy * F.col("v")) / (speed + F.lit(1e-6))).alias("downwind"))


def anisotropy(cells: DataFrame, keys: list[str], value: str, origin: tuple[float, float], wind: tuple[str, str], floor: float = 0.05) -> DataFrame:
    """Elongation of the footprint and the angle between its long axis and the wind.

    The weighted covariance comes from one pass of sums taken relative to ``origin``; the 2x2 eigenvalues
    are in closed form.
    """
    w = F.when(F.col(value) > floor, F.col(value))
    x, y = F.col("j") - F.lit(origin[1]), F.col("i") - F.lit(origin[0])
    u, v = wind
    s = cells.groupBy(*keys).agg(
        F.count(w).alias("n"), F.sum(w).alias("s"), F.sum(w * w).alias("s2"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"), F.max(u).alias("u"), F.max(v).alias("v")).where("n >= 2")
    c = F.col
    scale = c("s") - c("s2") / c("s")
    s = s.withColumns({
        "cxx": (c("sxx") - c("sx") * c("sx") / c("s")) / scale, "cyy": (c("syy") - c("sy") * c("sy") / c("s")) / scale,
        "cxy": (c("sxy") - c("sx") * c("sy") / c("s")) / scale})
    half_gap = F.sqrt(F.pow((c("cxx") - c("cyy")) / 2.0, F.lit(2.0)) + c("cxy") * c("cxy"))
    s = s.withColumns({"major": F.greatest((c("cxx") + c("cyy")) / 2.0 + half_gap, F.lit(0.0)), "minor": F.greatest((c("cxx") + c("cyy")) / 2.0 - half_gap, F.lit(0.0))})
    # A footprint on one line has no width but for rounding.
    ratio = F.when((c("minor") >= 1e-12) & (c("minor") >= 1e-9 * c("major")), F.sqrt(c("major") / c("minor"))).when(c("major") > 1e-12, F.lit(float("inf"))).otherwise(1.0)
    off = F.abs(F.degrees(F.atan2(2.0 * c("cxy"), c("cxx") - c("cyy")) / 2.0 - F.atan2(c("v"), c("u")))) % 180
    return s.withColumn("off", off).select(*keys, ratio.alias("anisotropy"), F.when(c("off") > 90, F.lit(180.0) - c("off")).otherwise(c("off")).alias("angle_error"))


def empty_forecasts(forecast: DataFrame, active: DataFrame, key: str = "run_id", value: str = "p") -> DataFrame:
    """Runs with active cells whose forecast is zero everywhere."""
    burning = active.where("fire > 0").select(key).distinct()
    peak = forecast.groupBy(key).agg(F.max(value).alias("peak"))
    return burning.join(peak, key, "left").where("coalesce(peak, 0e0) <= 0").select(key)
