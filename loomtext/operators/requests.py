"""Requests to models: validation, routing, pairing with responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.ordering import SLICE_ROWS, last_seen, ordered_scan

MISSING_PROMPT = "Missing 'prompt' or 'prompts' in request."
TIMED_OUT = "Request timed out"
TIMEOUT_SECONDS = 300


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``kind`` (batch, single, error) and ``error``. A list of prompts wins over a single one."""
    kind = (
        F.when(F.coalesce(F.array_size("prompts"), F.lit(0)) > 0, "batch")
        .when(F.coalesce(F.col("prompt"), F.lit("")) != "", "single")
        .otherwise("error")
    )
    return requests.withColumn("kind", kind).withColumn(
        "error", F.when(F.col("kind") == "error", MISSING_PROMPT)
    )


def expand_requests(requests: DataFrame, request_id: str) -> DataFrame:
    """One row (request_id, pos, prompt, model) per prompt of the valid requests."""
    prompts = F.when(F.col("kind") == "batch", F.col("prompts")).otherwise(F.array("prompt"))
    return (
        requests.where(F.col("kind") != "error")
        .select(request_id, "model", F.posexplode(prompts).alias("pos", "prompt"))
        .withColumn("pos", F.col("pos").cast("long"))
    )


def route_model(
    requests: DataFrame, registry: DataFrame, default: str, broadcast_rows: int = 10_000
) -> DataFrame:
    """Add ``routed_model``: the requested model where it is registered, else the default.

    The registry is counted up to ``broadcast_rows`` and broadcast only when it is that small.
    """
    names = registry.select("model").distinct().withColumn("_known", F.lit(True))
    if names.limit(broadcast_rows + 1).count() <= broadcast_rows:
        names = F.broadcast(names)
    joined = requests.join(names, "model", "left")
    routed = F.when(F.col("_known"), F.col("model")).otherwise(F.lit(default))
    return joined.withColumn("routed_model", routed).drop("_known")


def match_responses(
    requests: DataFrame,
    responses: DataFrame,
    key: str = "key",
    timeout_seconds: int = TIMEOUT_SECONDS,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Earliest response at or after each request and within the time limit, else a time-out row.

    Requests have (key, request_id, ts), responses (key, response_id, ts). Walking each key backwards
    in time, the last response seen is the earliest one still ahead, so no request meets more than one
    response and a key with very many events costs no more than its rows.
    """
    response = responses.select(
        key,
        "ts",
        F.lit(0).alias("_kind"),
        F.col("response_id").alias("_response"),
        F.struct("response_id", "ts").alias("_r"),
    )
    request = requests.select(key, "ts", F.lit(1).alias("_kind"), F.col("request_id").alias("_request"))
    scanned = ordered_scan(
        request.unionByName(response, allowMissingColumns=True),
        [key],
        ["-ts", "_kind", "-_response", "_request"],
        {"_ahead": last_seen("_r")},
        slice_rows,
        carry=True,
    )
    limit = F.col("ts") + F.make_dt_interval(secs=F.lit(timeout_seconds))
    in_time = F.col("_ahead.ts") <= limit
    matched = scanned.where(F.col("_kind") == 1)
    return matched.select(
        key,
        F.col("_request").alias("request_id"),
        F.col("ts").alias("request_ts"),
        F.when(in_time, F.col("_ahead.response_id")).alias("response_id"),
        F.when(in_time, F.col("_ahead.ts")).alias("response_ts"),
        F.when(F.coalesce(~in_time, F.lit(True)), TIMED_OUT).alias("error"),
    )


def zip_results(prompts: DataFrame, results: DataFrame, batch: str, pos: str) -> DataFrame:
    """Pair prompts and results by position; ``problem`` names the side that has no partner."""
    left = prompts.withColumn("_prompted", F.lit(True))
    right = results.withColumn("_answered", F.lit(True))
    joined = left.join(right, [batch, pos], "full")
    problem = F.when(F.col("_prompted").isNull(), "result without prompt").when(
        F.col("_answered").isNull(), "prompt without result"
    )
    return joined.withColumn("problem", problem).drop("_prompted", "_answered")


def still_active(questions: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Questions that have no row in ``finished``."""
    return questions.join(finished.select(key), key, "left_anti")
