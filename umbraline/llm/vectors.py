"""Vectors held as arrays of numbers: which rows take part, and their numbers inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrowed

#: Integers from here on may overflow 64 bits once they are squared and summed.
WIDE = 1 << 62


def usable(rows: DataFrame, *ids: str, column: str = "embedding") -> tuple[DataFrame, int]:
    """``ids, vector`` of the rows that take part, and how many components they have.

    A vector that is null, empty or holds a null or non-finite component takes no part, and
    neither does one of another length than most vectors have (of equally frequent lengths
    the smallest counts).  With no such row the number of components is 0.
    """
    x = F.col("vector")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    kept = narrowed(rows, *ids, column).withColumnRenamed(column, "vector").where(whole)
    lengths = kept.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    width = lengths["length"] if lengths else 0
    return kept.where(F.size("vector") == width), width


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, as longs; beyond 64 bits, the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The lists of an Arrow column, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False) if len(column) else np.zeros((0, 0), kind)


def largest(*values: np.ndarray) -> int:
    """The largest absolute value of some integers, exactly."""
    return max((max(-int(v.min()), int(v.max())) for v in values if v.size), default=0)
