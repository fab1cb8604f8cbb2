"""What the two operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered


def usable(rows: DataFrame) -> DataFrame:
    """(row_, vec_id, embedding array<double>, dim) of rows (row_, vec_id, embedding): vectors that are null, empty, zero or hold null or
    non-finite components are left out, as are null ids. Rows that repeat an id are vectors of their own."""
    rows = rows.select("row_", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("dim", F.size("embedding"))


def with_rows(table: DataFrame) -> DataFrame:
    """(row_, vec_id, embedding) of a table, its rows told apart by row_."""
    rows, row = numbered(table.select("vec_id", "embedding"))
    return rows.withColumnRenamed(row, "row_")


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column of `dim` doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def safe(x: np.ndarray) -> np.ndarray:
    """x, with rows whose squares would over- or underflow brought to ordinary size; cosines don't change."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return np.where((most > 1e140) | (most < 1e-140), x / most, x)


def cosines(x: np.ndarray, nx: np.ndarray, q: np.ndarray, nq: float) -> np.ndarray:
    """Cosines of rows of x with q; each depends on its row alone, so equal vectors have equal ones."""
    return (x * q).sum(axis=1) / (nx * nq)
