"""Run logs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.sources.runlogs import configs_of, iterations_of, parse_log_lines, stream_log_lines


def stream_trajectories(
    spark: SparkSession, path: str, files_per_trigger: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """(configs, iterations) of log files as they appear, parsed as the batch reader does."""
    parsed = parse_log_lines(stream_log_lines(spark, path, files_per_trigger))
    return configs_of(parsed), iterations_of(parsed)


def metadata_once(records: DataFrame, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """The first record to arrive per run_id, as long as repeats come within ``delay``.

    State is one key per run and is dropped after the delay. ``ts`` must be a TIMESTAMP.
    """
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["run_id"])
