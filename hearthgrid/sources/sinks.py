"""Writers. Every sink is a distributed write to a folder; the helpers return the table read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import geojson
from hearthgrid.session import scratch_path

# Columns and order of the CSV export.
EXPORT_COLUMNS = ("id", "lat", "lon", "acq_time", "confidence", "frp", "sensor", "source")


def through_csv(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    path = path or scratch_path(df.sparkSession, name)
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.option("timestampNTZFormat", stamp).csv(path, header=True)
    return df.sparkSession.read.option("timestampNTZFormat", stamp).csv(path, header=True, schema=df.schema)


def through_parquet(df: DataFrame, name: str, partitions: Sequence[str] = (), path: str | None = None) -> DataFrame:
    path = path or scratch_path(df.sparkSession, name)
    writer = df.repartition(*partitions, F.pmod(F.xxhash64(*df.columns[:3]), F.lit(16))) if partitions else df
    writer.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def validate_export(bbox: tuple[float, float, float, float], start: str, end: str) -> None:
    west, south, east, north = bbox
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("bbox must be min_lon, min_lat, max_lon, max_lat within the globe")
    if not start <= end:
        raise ValueError("start must not be after end")


def export_detections(detections: DataFrame, bbox, start: str, end: str, limit: int | None = None, path: str | None = None) -> DataFrame:
    """All detections of a box and time range as CSV files, oldest first; only a caller's own ``limit`` shortens them."""
    from hearthgrid.operators.filters import in_bbox, in_time

    validate_export(bbox, start, end)
    rows = detections.where(in_bbox(*bbox) & in_time(start, end)).orderBy("acq_time", "id").select(*EXPORT_COLUMNS)
    return through_csv(rows if limit is None else rows.limit(limit), "detections-csv", path)


def write_lines(features: DataFrame, column: str, name: str, path: str | None = None) -> DataFrame:
    """One JSON document per line, read back as text."""
    path = path or scratch_path(features.sparkSession, name)
    features.select(column).write.text(path)
    return features.sparkSession.read.text(path).withColumnRenamed("value", column)


def point_lines(detections: DataFrame) -> DataFrame:
    props = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c == "acq_time" else F.col(c) for c in EXPORT_COLUMNS if c not in ("lat", "lon")]
    return detections.select(geojson.point_feature(F.col("lon"), F.col("lat"), props).alias("feature"))


def aoi_lines(aois: DataFrame) -> DataFrame:
    return aois.select(geojson.polygon_feature(F.col("rings"), [F.col("aoi_id").alias("id"), F.col("name")]).alias("feature"))


def contour_lines(contours: DataFrame) -> DataFrame:
    props = [F.col("horizon_h").alias("horizon_hours"), F.col("threshold")]
    return contours.select("run_id", "horizon_h", "threshold", geojson.multipolygon_feature(F.col("polygons"), props).alias("feature"))


def write_contours(contours: DataFrame, path: str | None = None) -> DataFrame:
    """Contours as Parquet by run, with the GeoJSON text next to the keys."""
    return through_parquet(contour_lines(contours), "contours", ["run_id"], path)


def write_snapshot(rows: DataFrame, path: str | None = None) -> str:
    """train/ and eval/ Parquet plus a metadata row, from rows with a ``part`` column."""
    spark = rows.sparkSession
    path = path or scratch_path(spark, "snapshot")
    for part in ("train", "eval"):
        rows.where(F.col("part") == part).drop("part").write.parquet(f"{path}/{part}")
    meta = rows.where("part IS NOT NULL").groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label_numeric") == 1).alias("positives"),
                                                             F.min("acq_time").alias("first_time"), F.max("acq_time").alias("last_time"))
    meta.coalesce(1).write.json(f"{path}/metadata")
    return path


def write_hindcast(cases: DataFrame, min_active: int, path: str | None = None) -> str:
    """cases/ by event and an index/ manifest; cases below ``min_active`` burning cells are left out."""
    spark = cases.sparkSession
    path = path or scratch_path(spark, "hindcast")
    counts = cases.groupBy("event_id", "ref_time").agg(F.count_if(F.col("fire_t0") > 0).alias("active_t0"), F.count_if(F.col("y_obs") > 0).alias("positives"))
    kept = counts.where(F.col("active_t0") >= min_active)
    kept.withColumn("ref_time", F.col("ref_time").cast("string")).coalesce(1).write.json(f"{path}/index")
    rows = cases.join(kept.select("event_id", "ref_time"), ["event_id", "ref_time"], "left_semi")
    rows.repartition("event_id", F.pmod("cell_id", F.lit(8))).write.partitionBy("event_id").parquet(f"{path}/cases")
    return path


def weather_layout(cells: DataFrame) -> DataFrame:
    """Partition columns model/y/m/d/h from the run time, and the label of the run's box."""
    t = F.col("run_time")
    label = F.when(F.col("min_lon").isNull(), "global").otherwise(F.concat_ws("_", *[F.round(c, 2).cast("string") for c in ("min_lon", "min_lat", "max_lon", "max_lat")]))
    return cells.withColumns({"y": F.date_format(t, "yyyy"), "m": F.date_format(t, "MM"), "d": F.date_format(t, "dd"), "h": F.date_format(t, "HH"), "label": label})


def overwrite_slices(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace only the partitions present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
