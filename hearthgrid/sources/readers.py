"""Readers: feed CSV, weather cells, snapshots, hindcast cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.functions.parse import FEED_SCHEMA, optional_float


def read_feed_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = FEED_SCHEMA) -> DataFrame:
    """Feed rows as text; columns are matched by header name, typing is left to the parser."""
    return spark.read.csv(list(paths) if not isinstance(paths, str) else paths, header=True, schema=schema, enforceSchema=False)


def read_places_csv(spark: SparkSession, path: str, source: str, version: str, lat_col: str = "latitude", lon_col: str = "longitude",
                    type_col: str = "type", name_col: str = "name", bbox: tuple | None = None) -> DataFrame:
    """Industrial places from any CSV with the named columns; rows without usable coordinates are left out."""
    raw = spark.read.csv(path, header=True)
    out = raw.select(
        F.col(name_col).alias("name"), F.col(type_col).alias("kind"), optional_float(F.col(lat_col)).alias("lat"), optional_float(F.col(lon_col)).alias("lon"),
        F.lit(source).alias("source"), F.lit(version).alias("source_version"), F.to_json(F.struct(*raw.columns)).alias("meta"),
    ).where("lat IS NOT NULL AND lon IS NOT NULL")
    if bbox is not None:
        out = out.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    return out


def normalise_weather(df: DataFrame) -> DataFrame:
    """Rename latitude/longitude/time and add whole lead hours."""
    out = df.withColumnsRenamed({"latitude": "lat", "longitude": "lon", "time": "valid_time"})
    return out.withColumn("lead_h", F.timestamp_diff("HOUR", F.col("run_time"), F.col("valid_time")))


def read_weather(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Several weather files or a glob, combined by column name."""
    return spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """train and eval parts of a snapshot folder, with a ``part`` column."""
    return spark.read.parquet(f"{folder}/train").withColumn("part", F.lit("train")).unionByName(
        spark.read.parquet(f"{folder}/eval").withColumn("part", F.lit("eval")), allowMissingColumns=True)


INDEX_SCHEMA = "event_id long, ref_time string, active_t0 long, positives long"
CASE_SCHEMA = "cell_id long, ref_time timestamp_ntz, horizon_h int, i long, j long, y_pred double, y_obs double, fire_t0 double, event_id long"


def read_hindcast_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).json(f"{folder}/index")


def read_hindcast_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the cases listed in the manifest; files that have gone missing are skipped."""
    listed = read_hindcast_index(spark, folder).select("event_id", F.col("ref_time").cast("timestamp_ntz").alias("ref_time")).distinct()
    cells = spark.read.schema(CASE_SCHEMA).option("ignoreMissingFiles", "true").parquet(f"{folder}/cases")
    return cells.join(listed, ["event_id", "ref_time"], "left_semi")
