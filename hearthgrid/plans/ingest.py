"""Feed ingest: parse, reject, fold copies, insert what is new, account for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions.parse import accepted, confidence_bucket, parse_feed
from hearthgrid.operators.tables import insert_ignore

KEYS = ["source", "dedupe_hash"]


def new_detections(raw: DataFrame, target: DataFrame) -> DataFrame:
    """Rows to append to ``target`` (which has source and dedupe_hash)."""
    return insert_ignore(target, accepted(parse_feed(raw)), KEYS, ["acq_time", "row_id"])


def ingest_metrics(raw: DataFrame, target: DataFrame) -> DataFrame:
    """Per source: fetched, parsed, inserted, duplicates."""
    parsed = parse_feed(raw).groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("reject_reason").isNull()).alias("parsed"))
    fresh = new_detections(raw, target).groupBy("source").agg(F.count(F.lit(1)).alias("inserted"))
    return parsed.join(fresh, "source", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0))).withColumn(
        "duplicates", F.col("parsed") - F.col("inserted"))


def validation_summary(raw: DataFrame) -> DataFrame:
    """(metric, item, n) rows: totals, reject reasons, missing and out-of-range values, sensors, confidence buckets."""
    p = parse_feed(raw)
    good = F.col("reject_reason").isNull()
    items = F.array_compact(F.array(
        F.struct(F.lit("total").alias("metric"), F.lit("").alias("item")),
        F.when(good, F.struct(F.lit("parsed").alias("metric"), F.lit("").alias("item"))),
        F.when(~good, F.struct(F.lit("skipped").alias("metric"), F.col("reject_reason").alias("item"))),
        F.when(good & F.col("confidence_raw").isNull(), F.struct(F.lit("confidence").alias("metric"), F.lit("missing").alias("item"))),
        F.when(good & F.col("confidence_raw").isNotNull() & F.col("confidence_value").isNull(), F.struct(F.lit("confidence").alias("metric"), F.lit("out_of_range").alias("item"))),
        F.when(good & F.col("brightness_raw").isNull(), F.struct(F.lit("brightness").alias("metric"), F.lit("missing").alias("item"))),
        F.when(good & F.col("brightness_raw").isNotNull() & F.col("brightness_value").isNull(), F.struct(F.lit("brightness").alias("metric"), F.lit("out_of_range").alias("item"))),
        F.when(good, F.struct(F.lit("sensor").alias("metric"), F.coalesce("sensor_value", F.lit("unknown")).alias("item"))),
        F.when(good, F.struct(F.lit("bucket").alias("metric"), confidence_bucket(F.col("confidence_value")).alias("item"))),
    ))
    return p.select(F.explode(items).alias("e")).groupBy("e.metric", "e.item").agg(F.count(F.lit(1)).alias("n"))
