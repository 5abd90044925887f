"""Arrow columns of vectors as numpy matrices, and the rows of a vector table that take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of vectors.
BATCH_ROWS = 8192


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector.cast("array<double>"), number), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column without nulls as a matrix of ``dim`` columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
