"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthgrid.session import materialize

__all__ = ["corpus_session", "documents", "labels", "materialize"]

#: Arrow batches hold whole texts, so few rows go into one.
BATCH_ROWS = 512


def corpus_session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_session(spark).read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_session(spark).read.parquet(f"{folder}/labels.parquet")
