"""GeoJSON text built with JVM-side struct and array functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def feature(geometry: Column, properties: Sequence[Column]) -> Column:
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")),
        KEEP_NULLS,
    )


def point_feature(lon: Column, lat: Column, properties: Sequence[Column]) -> Column:
    return feature(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")), properties)


def box_feature(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, properties: Sequence[Column]) -> Column:
    ring = F.array(F.array(min_lon, min_lat), F.array(max_lon, min_lat), F.array(max_lon, max_lat),
                   F.array(min_lon, max_lat), F.array(min_lon, min_lat))
    return feature(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")), properties)


def polygon_feature(rings: Column, properties: Sequence[Column]) -> Column:
    """``rings`` is an array of arrays of (lon, lat) structs."""
    coords = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    return feature(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")), properties)


def multipolygon_feature(polygons: Column, properties: Sequence[Column]) -> Column:
    """``polygons`` is an array of ring arrays of (lon, lat) structs; null means empty."""
    coords = F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))))
    empty = F.array().cast("array<array<array<array<double>>>>")
    return feature(F.struct(F.lit("MultiPolygon").alias("type"), F.coalesce(coords, empty).alias("coordinates")), properties)
