"""Sharding by proportional stratified interleaving.

The rows of each source are put in a seeded random order; a row's fractional rank is its place in that order, shifted
by a phase of its source, over the number of the source's rows. Sorting all rows by fractional rank spreads every source evenly over
the whole, so cutting into equal counts gives shards that each have the mixture of the corpus, to within one row of each source.

Neither order is sorted in one task. Rows fall into buckets by the leading bits of their random key (first order) and
by their fractional rank (second order); bucket counts are summed up to offsets, and rows are numbered within a
bucket. The number of buckets follows the number of rows, so a source that holds most rows is spread like the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthgrid.llm.frames import documents, materialize

QUERY = "op3_sharding"
ORACLE_SQL = None
SHARDS, SEED = 24, 2024
#: Rows that are numbered together on average.
BUCKET_ROWS = 5_000
#: Buckets come from this many leading bits of a key.
KEY_BITS = 40


def _numbered(rows: DataFrame, groups: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Number rows from 0 within ``groups`` by bucket and ``order``."""
    counts = rows.groupBy(*groups, bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)) - 1
    return rows.join(offsets, [*groups, bucket]).withColumn(name, F.col("__base") + inside).drop("__base")


def interleaved(docs: DataFrame, shards: int = SHARDS, stratum: str = "source", seed: int = SEED) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Shards have equal row counts to within one; slots count from 0 in each. A null
    stratum is a stratum of its own. Rows with equal doc_ids are ordered by checksum and size, so that equal rows are
    interchangeable. Fewer rows than shards leave shards empty; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")), "sharding_rows")
    total = rows.count()
    buckets = 1 + total // BUCKET_ROWS
    rows = rows.withColumn("b", F.floor(F.shiftrightunsigned("key", 64 - KEY_BITS) * F.lit(float(buckets)) / F.lit(float(1 << KEY_BITS))))
    ranked = _numbered(rows, ["stratum"], "b", ["key", "doc_id", "text_crc32", "size"], "rank")
    phase = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "stratum"), 64 - KEY_BITS) + 0.5) / F.lit(float(1 << KEY_BITS))
    ranked = ranked.join(rows.groupBy("stratum").agg(F.count("*").alias("n")), "stratum")
    placed = ranked.withColumn("place", (F.col("rank") + phase) / F.col("n")).withColumn("b", F.floor(F.col("place") * buckets))
    ordered = _numbered(placed.select("doc_id", "size", "text_crc32", "stratum", "place", "rank", "b").withColumn("__all", F.lit(0)), ["__all"], "b", ["place", "stratum", "rank"], "g")
    shard = F.expr(f"g * {shards} div {max(total, 1)}")
    first = F.expr(f"(g * {shards} div {max(total, 1)} * {max(total, 1)} + {shards - 1}) div {shards}")
    return ordered.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("g") - first).cast("long").alias("slot"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of 24 shards of equal row counts."""
    found = interleaved(documents(spark, folder))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
