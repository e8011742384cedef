"""Structured Streaming jobs, run over all available input and compared with batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.models import DigestClient
from loomtext.operators.trajectories import iteration_stats
from loomtext.scratch import scratch_path
from loomtext.sources.runlogs import latest_runs
from loomtext.streaming.logs import metadata_once, stream_trajectories
from loomtext.streaming.progress import run_progress
from loomtext.streaming.requests import stream_ask, stream_match_timeouts
from loomtext.streaming.runner import drain
from loomtext.streaming.usage import stream_usage
from loomtext.suite.fixtures import CALLS_SQL, RUN_FILE_SQL, digest_sql, with_ctes
from loomtext.suite.log_queries import STATS_SQL, UPSERT_SQL, write_logs
from loomtext.suite.registry import query


def zoned(column: str):
    """A watermark needs TIMESTAMP; the tables hold TIMESTAMP_NTZ."""
    return F.col(column).cast("timestamp")


@query("str1_stream_trajectories", STATS_SQL.format(run=RUN_FILE_SQL.format(run_id="s.run_id")))
def str1(t):
    _, rows = stream_trajectories(t.spark, write_logs(t))
    emitted, _ = drain(iteration_stats(rows))
    return emitted.withColumn("seconds", F.round("seconds", 4))


@query(
    "str2_stream_usage",
    with_ctes(CALLS_SQL)
    + """
    SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, model, count(*) AS total_calls,
      CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens
    FROM calls GROUP BY date_trunc('day', ts), model
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM calls) - INTERVAL 1 HOUR
    """,
)
def str2(t):
    calls = t.stream("events").select(
        zoned("ts").alias("ts"),
        F.col("event_type").alias("model"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"),
    )
    emitted, _ = drain(stream_usage(calls))
    return emitted.select(
        F.unix_timestamp("window_start").alias("window_start"),
        "model",
        "total_calls",
        "total_input_tokens",
        "total_output_tokens",
    )


@query(
    "str3_stream_ask",
    f"""
    SELECT doc_id AS request_id, {digest_sql("text")} AS answer FROM documents
    """,
)
def str3(t):
    requests = t.stream("documents").select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("prompt")
    )
    # Every request arrives twice.
    repeated = requests.unionByName(requests)
    path = scratch_path(t.spark, "answers")
    checkpoint = scratch_path(t.spark, "checkpoint")
    stream_ask(repeated, path, checkpoint, client=DigestClient).awaitTermination()
    return t.spark.read.parquet(path).select("request_id", "answer")


def _in_files(t, rows, name: str, at: str, files: int = 5):
    """A table as a stream that brings one file of it after another, by rising ``at``."""
    path = scratch_path(t.spark, name)
    first, last = rows.agg(F.min(F.unix_timestamp(at)), F.max(F.unix_timestamp(at))).first()
    width = (last - first) // files + 1
    for number in range(files):
        own = F.floor((F.unix_timestamp(at) - first) / width) == number
        rows.where(own).coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "str4_stream_match_timeouts",
    """
    WITH r AS (SELECT event_id AS request_id, CASE WHEN event_id % 5 > 0 THEN event_id * 7 % 600 END AS delay FROM events)
    SELECT request_id, CASE WHEN delay <= 300 THEN CAST(delay AS BIGINT) END AS waited,
      CASE WHEN coalesce(delay, 999) > 300 THEN 'Request timed out' END AS error
    FROM r
    """,
)
def str4(t):
    """Several responses to a request, in several batches, and a closing event after the last of them."""
    start = F.unix_timestamp(zoned("ts"))
    requests = t.events.select(F.col("event_id").alias("request_id"), zoned("ts").alias("request_ts"))
    answered = t.events.where("event_id % 5 > 0").select(
        F.col("event_id").alias("request_id"),
        F.explode(F.array(*(F.timestamp_seconds(start + F.col("event_id") * 7 % 600 + later) for later in (0, 1, 90))))
        .alias("response_ts"),
    )
    last = t.events.agg(F.max(zoned("ts")).alias("ts"))
    closing = F.col("ts") + F.expr("INTERVAL 9 DAYS")
    no_id = F.lit(-1).cast("long").alias("request_id")
    requests = requests.unionByName(last.select(no_id, closing.alias("request_ts")))
    answered = answered.unionByName(last.select(no_id, closing.alias("response_ts")))
    emitted, _ = drain(
        stream_match_timeouts(
            _in_files(t, requests, "requests", "request_ts"), _in_files(t, answered, "responses", "response_ts"),
            delay="2 days",
        )
    )
    waited = F.unix_timestamp("response_ts") - F.unix_timestamp("request_ts")
    return emitted.where("request_id >= 0").select("request_id", waited.alias("waited"), "error")


@query(
    "str5_run_progress",
    """
    WITH turns AS (
      SELECT conv_id AS run_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i
      FROM conversations WHERE role = 'assistant'),
    ends AS (SELECT run_id, coalesce(min(i) FILTER (n % 11 = 0 OR i = 30), max(i)) AS last FROM turns GROUP BY 1)
    SELECT run_id, count(*) AS n_iterations, count(*) FILTER (n % 7 = 0) AS n_errors,
      bool_or(n % 11 = 0) AS answered, bool_or(n % 11 = 0 OR i = 30) AS ended
    FROM turns JOIN ends USING (run_id) WHERE i <= last GROUP BY 1
    """,
)
def str5(t):
    turns = t.stream("conversations").where("role = 'assistant'")
    rows = turns.select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("iteration"),
        (F.length("text") % 7 == 0).alias("has_error"),
        (F.length("text") % 11 == 0).alias("has_final"),
    )
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    t.spark.conf.set(
        provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    try:
        emitted, _ = drain(run_progress(rows), 300)
    finally:
        t.spark.conf.set(provider, before)
    latest = F.max_by(F.struct("n_errors", "answered", "ended"), "n_iterations").alias("_s")
    return (
        emitted.groupBy("run_id")
        .agg(F.max("n_iterations").alias("n_iterations"), latest)
        .select("run_id", "n_iterations", "_s.*")
    )


@query("snk2_stream_upsert", UPSERT_SQL)
def snk2_stream(t):
    rows = t.stream("events").select(
        "user_id", "event_type", "event_id", F.round("value", 4).alias("value")
    )
    appended, _ = drain(rows)
    return latest_runs(appended, ["user_id", "event_type"], "event_id")


@query("str6_metadata_once", "SELECT DISTINCT user_id AS run_id FROM events")
def str6(t):
    records = t.stream("events").select(F.col("user_id").alias("run_id"), zoned("ts").alias("ts"))
    emitted, _ = drain(metadata_once(records, "40 days"))
    return emitted.select("run_id")
