"""Run a stream over what has arrived, into a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomtext.scratch import scratch_path


def start_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start an append stream into Parquet files at ``path`` that stops when the input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def drain(stream: DataFrame, limit_seconds: int = 3600) -> tuple[DataFrame, StreamingQuery]:
    """Process all available input; the emitted rows, and the finished query for its progress."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    query = start_to_table(stream, path, scratch_path(spark, "checkpoint"))
    if not query.awaitTermination(limit_seconds):
        query.stop()
        raise TimeoutError(f"The stream did not end within {limit_seconds} seconds.")
    return spark.read.schema(stream.schema).parquet(path), query


def rows_dropped_late(query: StreamingQuery) -> int:
    """Rows that came later than the watermark allowed, over the progress the query still holds."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
