"""Vectors as integer rows of one length, and sums over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.session import ship_package


def finite(vector: str) -> Column:
    """Whether a vector is there and has no NULL, NaN or infinite entry."""
    entry = F.col(vector).cast("array<double>")
    bad = F.exists(entry, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def scaled(vector: str, scale: int, offset: int, limit: int) -> Column:
    """floor(scale * entry) + offset as integers; beyond ``limit`` the job ends with an error, as sums
    could not be exact."""

    def entry(x: Column) -> Column:
        whole = F.floor(F.lit(scale) * x) + F.lit(offset)
        message = F.lit(f"an entry of {vector} is beyond {limit} when scaled")
        return F.when(F.abs(whole) < limit, whole).otherwise(F.raise_error(message).cast("long"))

    return F.transform(F.col(vector).cast("array<double>"), entry).cast("array<int>")


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """A list column without NULLs as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), width)


#: Takes a task's batches, yields the numbers whose sums over all tasks are wanted.
Partial = Callable[[Iterator[pa.RecordBatch]], np.ndarray]


def summed(rows: DataFrame, partial: Partial, size: int, kind: str) -> np.ndarray:
    """Sums over all tasks of ``size`` numbers of ``kind`` (``long`` or ``double``), which every task
    makes in one piece. Tasks hand on ``size`` rows, the driver gets as many."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = partial(batches)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int64)), pa.array(values)], names=["place", "value"]
        )

    parts = rows.mapInArrow(run, f"place long, value {kind}")
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[row.place] = row.value
    return out
