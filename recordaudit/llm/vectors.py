"""What the vector operators share: usable vectors, parallelism, and arrays to and from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components of a block (2 MB of doubles); a table with fewer rows per core is cut finer, down to ``LEAST_ROWS`` rows.
BLOCK_VALUES = 1 << 18
LEAST_ROWS = 512


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def usable(rows: DataFrame, vector: str, holds: Column) -> tuple[DataFrame, int, int]:
    """Rows of which ``holds`` is true and whose vector has the table's most common length: (rows, their number, that length).

    Vectors of different lengths have no inner product or distance. Of equally common lengths the greatest is taken.
    """
    rows = rows.filter(F.coalesce(holds, F.lit(False)))
    common = rows.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return rows, 0, 0
    return rows.filter(F.size(vector) == common["dims"]), common["count"], common["dims"]


def block_rows(dims: int) -> int:
    return max(64, min(4096, BLOCK_VALUES // max(1, dims)))


def parts(spark: SparkSession, n: int, rows: int) -> int:
    """Partitions for n rows: blocks of ``rows``, or smaller ones while cores would be idle."""
    cores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS))
    return max(1, cores, -(-n // rows))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column with ``dims`` components each, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dims)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
