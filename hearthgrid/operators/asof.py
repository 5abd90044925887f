"""As-of joins by merging: the last known row at or before each asked one, per key.

Both sides are one table, dealt out by ranges of (key, time) and sorted. A task carries the last known row forward; what
it has last goes to the tasks behind it as a summary of one row per task. Ties are broken by a hash, so that any number of
rows may ask for one key and time and are still dealt to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.session import materialize


def last_before(asked: DataFrame, known: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """``asked`` with ``values`` of the last row of ``known`` with the same key (long) at or before its time (long); null if there is none.

    Of known rows of one key and time any one is taken, so reduce them first. Asked rows without a key or time find nothing.
    """
    spark = asked.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    left = asked.select(F.col(key).cast("long").alias("key"), F.col(at).cast("long").alias("at"), F.lit(1).alias("kind"), F.struct(*asked.columns).alias("asked"))
    right = known.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(at).cast("long").alias("at"), F.lit(0).alias("kind"), F.struct(*values).alias("known"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("tie", F.xxhash64("asked"))
    order = ["key", "at", "kind", "tie"]
    dealt = both.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("task"), "key", "at", "kind", "asked", "known")
    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("key", T.LongType()), dealt.schema["asked"], dealt.schema["known"], T.StructField("open", T.BooleanType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        last, last_key, task = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0)[:1]
            keys, times = batch.column(1), batch.column(2)
            kind = batch.column(3).to_numpy()
            rows = batch.column(5)
            at_row = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
            number = keys.fill_null(0).to_numpy()
            usable = keys.is_valid().to_numpy(zero_copy_only=False) & times.is_valid().to_numpy(zero_copy_only=False)
            seen_key = np.where(at_row >= 0, number[np.maximum(at_row, 0)], 0 if last_key is None else last_key)
            seen = (at_row >= 0) | (last is not None)
            held = pa.concat_arrays([rows[:1] if last is None else last, rows])
            index = pa.array(np.where(at_row >= 0, at_row + 1, 0), mask=~(seen & usable & (seen_key == number)))
            wanted = pa.array(np.flatnonzero(kind == 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(wanted), keys.take(wanted), batch.column(4).take(wanted), held.take(index).take(wanted), pa.array(usable & ~seen).take(wanted)], names)
            if at_row[-1] >= 0:
                end = int(at_row[-1])
                last, last_key = rows[end:end + 1], int(number[end])
        if last is not None:
            yield pa.RecordBatch.from_arrays([task, pa.array([last_key], pa.int64()), pa.nulls(1, batch.column(4).type), last, pa.array([None], pa.bool_())], names)

    found = materialize(dealt.mapInArrow(carry, schema), "as-of")
    # At most one row per task on either side.
    ends = found.where("open IS NULL").select("task", F.struct("key", "known").alias("end"))
    begins = found.where("open").select("task").distinct()
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    summary = begins.join(ends, "task", "full_outer").withColumn("before", F.last("end", ignorenulls=True).over(before)).select("task", "before")
    met = found.where("open IS NOT NULL").join(summary, "task", "left")
    carried = F.when(F.col("open") & (F.col("before.key") == F.col("key")), F.col("before.known")).otherwise(F.col("known"))
    return met.select("asked.*", carried.alias("_known")).select(*asked.columns, *[F.col(f"_known.{v}").alias(v) for v in values])
