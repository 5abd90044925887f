"""Score formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5
# Weights of the composite likelihood.
WEIGHTS = {"confidence": 0.2, "persistence": 0.3, "landcover": 0.25, "weather": 0.25}
PRIOR_WEIGHT = 0.2
# Plausibility of land-cover classes (any other class is neutral).
LANDCOVER_SCORES = {10: 1.0, 20: 1.0, 30: 1.0, 40: 0.7, 50: 0.1, 60: 0.1, 70: 0.1, 80: 0.1, 90: 0.1, 95: 0.1, 100: 0.1}
# Share of the static and the dynamic part of the risk score.
RISK_STATIC, RISK_DYNAMIC = 0.6, 0.4


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it and return a bound)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def confidence_norm(confidence: Column) -> Column:
    return F.coalesce(clamp(confidence, 0.0, 100.0) / F.lit(100.0), F.lit(NEUTRAL))


def confidence_prior(confidence: Column, max_weight: float = PRIOR_WEIGHT) -> Column:
    return confidence_norm(confidence) * F.lit(max_weight)


def likelihood(confidence: Column, persistence: Column, landcover: Column, weather: Column, masked: Column) -> Column:
    def part(score: Column, name: str) -> Column:
        return F.coalesce(score, F.lit(NEUTRAL)) * F.lit(WEIGHTS[name])

    total = (
        part(confidence, "confidence") + part(persistence, "persistence")
        + part(landcover, "landcover") + part(weather, "weather")
    )
    return F.when(masked, F.lit(0.0)).otherwise(clamp(total, 0.0, 1.0))


def persistence_score(cluster_size: Column, sensor_count: Column) -> Column:
    n = cluster_size.cast("double")
    base = (
        F.when(n <= 1, F.lit(0.2))
        .when(n <= 3, F.lit(0.3) + (n - 2.0) * 0.1)
        .when(n <= 9, F.lit(0.5) + (n - 4.0) * 0.033)
        .otherwise(F.least(F.lit(0.9), F.lit(0.7) + (n - 10.0) * 0.02))
    )
    return F.least(F.lit(1.0), base + F.when(sensor_count >= 2, F.lit(0.1)).otherwise(F.lit(0.0)))


def landcover_score(cover_class: Column) -> Column:
    out = F.lit(NEUTRAL)
    for code, score in LANDCOVER_SCORES.items():
        out = F.when(cover_class == code, F.lit(score)).otherwise(out)
    return out


def weather_points(rh: Column, precip_mm: Column, wind_ms: Column) -> Column:
    """0.5 with penalties and bonuses, clamped to [0.1, 1]; a missing variable adds nothing."""

    def step(condition: Column, amount: float) -> Column:
        return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))

    raw = F.lit(NEUTRAL) + step(rh > 70.0, -0.3) + step(precip_mm > 10.0, -0.2) + step(rh < 40.0, 0.2) + step(wind_ms > 3.0, 0.1)
    return clamp(raw, 0.1, 1.0)


def weather_score(rh: Column, precip_mm: Column, wind_ms: Column) -> Column:
    """Null when none of the three variables exists."""
    known = rh.isNotNull() | precip_mm.isNotNull() | wind_ms.isNotNull()
    return F.when(known, weather_points(rh, precip_mm, wind_ms))


def risk_score(static: Column, dynamic: Column) -> Column:
    return F.coalesce(F.lit(RISK_STATIC) * static + F.lit(RISK_DYNAMIC) * dynamic, static)


def risk_level(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.6, "medium").otherwise("high")


def severity(score: Column) -> Column:
    return F.when(score >= 0.66, "high").when(score >= 0.33, "medium").otherwise("low")


def frp_size(frp: Column) -> Column:
    return F.when(frp > 100, 4).when(frp > 50, 3).when(frp > 20, 2).otherwise(1)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)
