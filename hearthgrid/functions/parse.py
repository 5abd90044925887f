"""Typing of text feed rows: coordinates, times, confidence, and the dedupe hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted ranges of the feed.
LAT_RANGE = (-90.0, 90.0)
LON_RANGE = (-180.0, 180.0)
CONFIDENCE_RANGE = (0.0, 100.0)
BRIGHTNESS_RANGE = (200.0, 500.0)
# Text levels of confidence in the feed.
CONFIDENCE_TEXT = {"h": 90.0, "high": 90.0, "n": 50.0, "nominal": 50.0, "l": 10.0, "low": 10.0}

NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

FEED_FIELDS = (
    "latitude", "longitude", "acq_date", "acq_time", "confidence", "confidence_text", "brightness",
    "bright_t31", "frp", "scan", "track", "instrument", "satellite", "sensor", "daynight",
)
FEED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in FEED_FIELDS])


def optional_float(text: Column) -> Column:
    """Number or null. The pattern keeps out spellings such as '1d' or 'nan' that a cast would take."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def acquisition_time(date: Column, hhmm: Column) -> Column:
    """``acq_date`` plus zero-padded HHMM; null when either is malformed."""
    clock = F.coalesce(hhmm, F.lit(""))
    padded = F.lpad(clock, 4, "0")
    text = F.concat(date, F.lit(" "), padded)
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz")
    return F.when((F.length(clock) <= 4) & padded.rlike("^[0-9]{4}$") & date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), parsed)


def confidence_value(numeric: Column, text: Column) -> Column:
    level = F.lower(text)
    mapped = F.lit(None).cast("double")
    for word, value in CONFIDENCE_TEXT.items():
        mapped = F.when(level == word, F.lit(value)).otherwise(mapped)
    return F.coalesce(optional_float(numeric), mapped)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def within(value: Column, bounds: tuple[float, float]) -> Column:
    """The value, or null when it lies outside the closed range."""
    return F.when(value.between(*bounds), value)


def confidence_bucket(confidence: Column) -> Column:
    return (
        F.when(confidence.isNull(), "unknown")
        .when(confidence < 30, "low")
        .when(confidence < 70, "nominal")
        .otherwise("high")
    )


def dedupe_hash(source: Column, lat: Column, lon: Column, when: Column) -> Column:
    """sha1 over source, both coordinates in 1e-4 degrees (half up) and the UTC second."""

    def ticks(c: Column) -> Column:
        return F.floor(c * F.lit(10000.0) + F.lit(0.5)).cast("string")

    stamp = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")
    return F.sha1(F.concat_ws("|", source, ticks(lat), ticks(lon), stamp))


def parse_feed(rows: DataFrame) -> DataFrame:
    """Typed columns plus ``reject_reason`` (null for a good row); nothing is dropped here."""
    lat, lon = optional_float(F.col("latitude")), optional_float(F.col("longitude"))
    typed = rows.withColumns({
        "lat": lat,
        "lon": lon,
        "acq_at": acquisition_time(F.col("acq_date"), F.col("acq_time")),
        "confidence_raw": confidence_value(F.col("confidence"), F.col("confidence_text")),
        "brightness_raw": optional_float(F.col("brightness")),
    })
    bad_place = F.col("lat").isNull() | F.col("lon").isNull() | ~F.col("lat").between(*LAT_RANGE) | ~F.col("lon").between(*LON_RANGE)
    return typed.withColumns({
        "reject_reason": F.when(bad_place, "invalid_coord").when(F.col("acq_at").isNull(), "invalid_time"),
        "confidence_value": within(F.col("confidence_raw"), CONFIDENCE_RANGE),
        "brightness_value": within(F.col("brightness_raw"), BRIGHTNESS_RANGE),
        "bright_t31_value": optional_float(F.col("bright_t31")),
        "frp_value": optional_float(F.col("frp")),
        "sensor_value": first_filled(F.col("instrument"), F.col("satellite"), F.col("sensor")),
    })


def accepted(parsed: DataFrame) -> DataFrame:
    """Good rows in the detection layout, with the dedupe hash."""
    out = parsed.where(F.col("reject_reason").isNull()).select(
        *[c for c in ("row_id",) if c in parsed.columns],
        "source", "lat", "lon", F.col("acq_at").alias("acq_time"), F.col("sensor_value").alias("sensor"),
        F.col("confidence_value").alias("confidence"), F.col("brightness_value").alias("brightness"),
        F.col("bright_t31_value").alias("bright_t31"), F.col("frp_value").alias("frp"),
    )
    return out.withColumn("dedupe_hash", dedupe_hash(F.col("source"), F.col("lat"), F.col("lon"), F.col("acq_time")))
