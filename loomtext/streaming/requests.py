"""Requests as a stream: answering them, and timing out those that get no response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.models import ClientFactory, EchoClient
from loomtext.operators.asking import ask, errors_as_values
from loomtext.operators.requests import TIMED_OUT, TIMEOUT_SECONDS


def stream_ask(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    request_id: str = "request_id",
    client: ClientFactory = EchoClient,
    **options,
) -> StreamingQuery:
    """Answer requests as they arrive; each id is answered once in the Parquet table at ``path``.

    Which ids have been asked is keyed state of the stream, kept with its checkpoint, so a batch reads nothing
    of the answers given before it. A batch is written below its own number; a retried one meets the same
    state and overwrites its earlier attempt.
    """

    def answer(batch: DataFrame, number: int) -> None:
        answers = errors_as_values(ask(batch, client, **options))
        answers.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        requests.dropDuplicates([request_id]).writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_match_timeouts(
    requests: DataFrame,
    responses: DataFrame,
    timeout_seconds: int = TIMEOUT_SECONDS,
    delay: str = "1 minute",
) -> DataFrame:
    """Requests (request_id, request_ts) with the earliest response (request_id, response_ts) in time, or a
    time-out: one row per request.

    Responses in time meet their request in a stream-stream join, whose state is dropped past the limit; the
    earliest of them is kept per request until the watermark that the join hands on has passed it, when none
    can come any more. So a row comes once the watermark passes the request's limit. Pairing is by unique
    request id, so state spreads evenly; a request that repeats with its time is one request.
    """
    asked = requests.withWatermark("request_ts", delay)
    answered = responses.select(
        F.col("request_id").alias("answered_id"), "response_ts"
    ).withWatermark("response_ts", delay)
    # A literal interval, which the state clean-up can reason about.
    limit = F.col("request_ts") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    in_time = (F.col("response_ts") >= F.col("request_ts")) & (F.col("response_ts") <= limit)
    joined = asked.join(
        answered, (F.col("request_id") == F.col("answered_id")) & in_time, "left_outer"
    )
    others = [c for c in requests.columns if c not in ("request_id", "request_ts")]
    first = joined.groupBy("request_id", "request_ts").agg(
        *(F.any_value(c).alias(c) for c in others), F.min("response_ts").alias("response_ts")
    )
    return first.select(
        *requests.columns,
        "response_ts",
        F.when(F.col("response_ts").isNull(), TIMED_OUT).alias("error"),
    )
