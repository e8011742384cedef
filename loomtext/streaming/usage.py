"""Running token usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_usage(calls: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Usage per model and tumbling window, emitted once a window is past the watermark."""
    return (
        calls.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "model")
        .agg(
            F.count(F.lit(1)).alias("total_calls"),
            F.sum("input_tokens").alias("total_input_tokens"),
            F.sum("output_tokens").alias("total_output_tokens"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "model",
            "total_calls",
            "total_input_tokens",
            "total_output_tokens",
        )
    )
