"""Structured Streaming versions of the ingest loop: dedupe, scoring, bucket counts, events."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.functions.parse import accepted, parse_feed
from hearthgrid.session import materialize, scratch_path

LOGGER = logging.getLogger(__name__)
WATERMARK = "10 days"  # fixed value: the feed re-sends at most ten days


def parquet_stream(spark: SparkSession, folder: str, pattern: str, schema, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def csv_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("header", "true").csv(folder)


def deduplicated(raw: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Typed, accepted rows; a (source, hash) seen within the watermark is dropped. Older rows belong to the batch backfill."""
    rows = accepted(parse_feed(raw)).withColumn("acq_time", F.col("acq_time").cast("timestamp"))
    return rows.withWatermark("acq_time", watermark).dropDuplicatesWithinWatermark(["source", "dedupe_hash"])


def bucket_counts(detections: DataFrame, hours: int, watermark: str = WATERMARK) -> DataFrame:
    """Tumbling counts; a window is emitted once the watermark has passed its end."""
    timed = detections.withColumn("acq_time", F.col("acq_time").cast("timestamp")).withWatermark("acq_time", watermark)
    counted = timed.groupBy(F.window("acq_time", f"{hours} hours")).agg(F.count(F.lit(1)).alias("detections"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("ref_time"), "detections")


def events(detections: DataFrame, keys: list[str], interval_h: int, watermark: str = WATERMARK) -> DataFrame:
    """Gap-split events per key: a session closes after 1.5 intervals without a detection."""
    timed = detections.withColumn("acq_time", F.col("acq_time").cast("timestamp")).withWatermark("acq_time", watermark)
    gap = f"{int(interval_h * 90)} minutes"
    grouped = timed.groupBy(*keys, F.session_window("acq_time", gap)).agg(F.count(F.lit(1)).alias("detections"))
    return grouped.select(*keys, F.col("session_window.start").cast("timestamp_ntz").alias("event_start"), "detections")


def run_available(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything that is there, append it to a Parquet folder (exactly once), and read it back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, f"{name}-out")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def score_batches(stream: DataFrame, name: str, steps: dict[str, tuple[Callable[[DataFrame], DataFrame], str]],
                  finish: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """Run every score step on every micro-batch and write one partition per batch.

    A step is ``(rows -> (id, columns), the columns as DDL)``. Its result is written within the ``try``, so a failure
    while it runs is caught too: it is logged and the step's columns are null for that batch. ``finish`` turns the
    scored rows into what is stored. Rewriting a replayed batch replaces its own partition only, so a retry after a
    lost driver stays exact.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, f"{name}-out")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch, f"{name}-batch")
        scored = rows
        for label, (step, columns) in steps.items():
            try:
                scored = scored.join(materialize(step(rows), f"{name}-{label}"), "id", "left")
            except Exception:  # noqa: BLE001 - a scoring step must not stop the ingest
                LOGGER.exception("scoring step %s failed for batch %s", label, batch_id)
                scored = scored.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in columns.split(", ")})
        finish(scored).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def with_open_windows(closed: DataFrame, everything: DataFrame, keys: list[str]) -> DataFrame:
    """What a stream has put out, and those rows of the batch result that it still holds back as open.

    The closing step at the end of a feed: windows that the watermark has not passed come from the batch aggregate.
    """
    # Written first: joined on its start, a session window would be planned before its rows are merged.
    whole = materialize(everything, "all-windows")
    return closed.unionByName(whole.join(closed, keys, "left_anti"))
