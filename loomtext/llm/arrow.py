"""Columns computed in Arrow batches, for operators that SQL functions cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomtext.session import ship_package

SLICE_BYTES = 4_000_000
#: Takes the batches' columns of one task, yields the result columns of each batch in turn.
Compute = Callable[[Iterator[list[pa.Array]]], Iterator[list[pa.Array]]]


def add_columns(
    df: DataFrame, keep: list[str], inputs: list, results: str, compute: Compute
) -> DataFrame:
    """The ``keep`` columns of every row, in order, beside what ``compute`` makes of ``inputs``.

    ``results`` is a DDL schema. A kept column with the name of a result gives way.
    """
    made = StructType.fromDDL(results)
    keep = [c for c in keep if c not in made.names]
    ship_package(df.sparkSession)
    rows = df.select(
        *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
        *[F.col(c).alias(f"_in{i}") if isinstance(c, str) else c.alias(f"_in{i}")
          for i, c in enumerate(inputs)],
    )
    n = len(keep)
    schema = StructType(
        [StructField(f.name, f.dataType) for f in rows.schema.fields[:n]] + made.fields
    )

    def run(batches):
        kept: list[list[pa.Array]] = []

        def columns():
            for batch in batches:
                # Small slices keep the Python objects of a batch from piling up.
                step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    kept.append(part.columns[:n])
                    yield part.columns[n:]

        for arrays in compute(columns()):
            all_columns = [*kept.pop(0), *arrays]
            yield pa.RecordBatch.from_arrays(all_columns, names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.toDF(*keep, *made.names)


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; NULL is empty."""
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a column; NULL is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


_in_worker: dict[tuple, object] = {}


def kept_in_worker(key: tuple, build: Callable[[], object]):
    """What ``build`` makes, kept for later tasks of the same Python worker. One at a time."""
    if key not in _in_worker:
        _in_worker.clear()
        _in_worker[key] = build()
    return _in_worker[key]
