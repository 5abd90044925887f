"""Decay weights of the wind-shaped neighbourhood as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KernelConfig:
    """Defaults of the spread heuristic."""

    base_spread_km_h: float = 0.05
    wind_influence: float = 0.1
    wind_elongation: float = 1.5
    decay_km: float = 2.0
    fire_threshold: float = 0.0
    max_width: int | None = None
    slope_bias: bool = False
    slope_influence: float = 0.35
    slope_reference_deg: float = 30.0

    def __post_init__(self):
        if self.max_width is not None and (self.max_width < 7 or self.max_width % 2 == 0):
            raise ValueError("max_width must be odd and at least 7")

    @property
    def wind_bias(self) -> float:
        return min(max((self.wind_elongation - 1.0) / (self.wind_elongation + 1.0), 0.0), 0.9)


def cell_km(cell_deg: float, mean_lat: Column) -> tuple[Column, Column]:
    """(dy, dx) of a cell in km."""
    dy = F.lit(max(cell_deg * 111.0, 1e-6))
    dx = F.greatest(F.lit(cell_deg) * (F.lit(111.0) * F.cos(F.radians(mean_lat))), F.lit(1e-6))
    return dy, dx


def kernel_half(horizon_h: Column, wind: Column, dy: Column, dx: Column, cfg: KernelConfig) -> Column:
    """Half width in cells: three times the reach, at least 3; ``max_width`` cuts it only where a caller sets one."""
    reach = F.lit(cfg.base_spread_km_h) * horizon_h + wind * horizon_h * F.lit(cfg.wind_influence)
    pixels = F.greatest(reach / dx, reach / dy)
    width = F.floor(F.greatest(F.lit(7.0), F.lit(2.0) * (pixels * F.lit(3.0)) + F.lit(1.0)))
    odd = F.when(width % 2 == 0, width + 1).otherwise(width)
    return F.floor((odd if cfg.max_width is None else F.least(odd, F.lit(cfg.max_width))) / 2)


def kernel_weight(di: Column, dj: Column, horizon_h: Column, u: Column, v: Column, dy: Column, dx: Column,
                  cfg: KernelConfig, slope_deg: Column | None = None, aspect_deg: Column | None = None) -> Column:
    """Exponential decay of an effective distance: shorter downwind, longer upwind, scaled by wind speed."""
    y, x = di * dy, dj * dx
    distance = F.sqrt(x * x + y * y)
    bearing = F.atan2(y, x)
    wind = F.sqrt(u * u + v * v)
    shaped = distance * (F.lit(1.0) - F.lit(cfg.wind_bias) * F.cos(bearing - F.atan2(v, u)))
    stretched = shaped / (F.lit(1.0) + wind * F.lit(cfg.wind_influence) / F.lit(cfg.base_spread_km_h + 1e-6))
    effective = F.when(wind > 1e-6, stretched).otherwise(distance)
    if cfg.slope_bias and slope_deg is not None and aspect_deg is not None:
        uphill = F.radians(F.lit(90.0) - F.pmod(aspect_deg + F.lit(180.0), F.lit(360.0)))
        share = F.least(F.greatest(slope_deg / F.lit(max(cfg.slope_reference_deg, 1e-6)), F.lit(0.0)), F.lit(1.0))
        strength = F.least(F.lit(cfg.slope_influence) * share, F.lit(0.9))
        tilted = effective * (F.lit(1.0) - strength * F.cos(bearing - uphill))
        effective = F.when((slope_deg > 0) & aspect_deg.isNotNull(), tilted).otherwise(effective)
    return F.exp(-effective / (F.lit(cfg.base_spread_km_h) * horizon_h + F.lit(cfg.decay_km)))
