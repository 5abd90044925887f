"""Feature columns for the noise classifier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Text confidence levels as the feature builder reads them (they differ from the parser's).
FEATURE_CONFIDENCE = {"high": 90.0, "nominal": 60.0, "low": 30.0}
MISSING_CONFIDENCE = 30.0


def confidence_feature(confidence: Column, is_text: bool = False) -> Column:
    if not is_text:
        return F.coalesce(confidence, F.lit(MISSING_CONFIDENCE))
    out = F.lit(MISSING_CONFIDENCE)
    for word, value in FEATURE_CONFIDENCE.items():
        out = F.when(confidence == word, F.lit(value)).otherwise(out)
    return out


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def time_features(when: Column) -> dict[str, Column]:
    sin_hour, cos_hour = cyclic(F.hour(when) + F.minute(when) / F.lit(60.0), 24.0)
    sin_doy, cos_doy = cyclic(F.dayofyear(when).cast("double"), 365.25)
    return {"sin_hour": sin_hour, "cos_hour": cos_hour, "sin_doy": sin_doy, "cos_doy": cos_doy}


def firms_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "confidence_norm": confidence_feature(F.col("confidence")),
        "brightness_minus_t31": F.col("brightness") - F.col("bright_t31"),
        "is_day": F.coalesce((F.col("daynight") == "D").cast("int"), F.lit(0)),
    })


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Position in the sorted list of distinct values, -1 for null. The window runs over the dictionary only."""
    words = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = words.withColumn(out, F.dense_rank().over(Window.orderBy(column)) - 1)
    return df.join(codes, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def aspect_parts(aspect_deg: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(aspect_deg)), F.cos(F.radians(aspect_deg))


def align_features(df: DataFrame, feature_list: list[str], keep: list[str]) -> DataFrame:
    """Select the features in list order, adding missing ones as null doubles."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(f).cast("double") if f in have else F.lit(None).cast("double")).alias(f) for f in feature_list])
