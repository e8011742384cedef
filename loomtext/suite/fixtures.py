"""Run logs, calls, variables and requests derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.ordering import group_size, ordered_scan, row_number
from loomtext.schema import BLOCK, CALL, RESULT
from loomtext.suite.registry import Tables

ECHO_SQL = "('Mock response to: ' || substr({prompt}, 1, 50))"


def sql_text(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def digest_sql(prompt: str) -> str:
    """SQL of the digest client's answer to ``prompt``."""
    return f"(length({prompt}) || ':' || md5({prompt}))"


def echo_sql(prompt: str) -> str:
    """SQL of the echo client's answer to ``prompt``."""
    return ECHO_SQL.format(prompt=prompt)


def traj(tables: Tables) -> DataFrame:
    """One row per assistant turn, seen as an iteration of a run."""
    turns = tables.conversations
    assistant = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("run_id"), "turn", "text"
    )
    numbered = ordered_scan(
        assistant, ["run_id"], ["turn"], {"iteration": row_number(), "n_iter": group_size()}
    )
    return numbered.select(
        "run_id",
        "iteration",
        "turn",
        "n_iter",
        "text",
        F.expr(
            r"""CASE WHEN iteration = n_iter
                THEN concat(text, '\n', 'FINAL(', replace(substr(text, 1, 20), ')', ''), ')')
                ELSE concat(text, '\n```repl\nx', turn, ' = ', length(text), '\n```') END"""
        ).alias("response"),
        F.expr(
            "CASE WHEN iteration < n_iter THEN concat('x', turn, ' = ', length(text)) END"
        ).alias("code"),
        F.expr(
            """CASE WHEN iteration = n_iter THEN NULL
               WHEN length(text) % 7 = 0 THEN 'ZeroDivisionError: division by zero' ELSE '' END"""
        ).alias("stderr"),
        F.expr(
            "CASE WHEN iteration < n_iter THEN CAST(length(text) % 100 AS DOUBLE) / 100 END"
        ).alias("block_seconds"),
        F.expr(
            "CASE WHEN length(text) % 5 > 0 THEN CAST(length(text) % 300 AS DOUBLE) / 100 END"
        ).alias("iteration_time"),
    )


TRAJ_SQL = r"""
traj AS (
  SELECT run_id, iteration, turn, n_iter, text,
    CASE WHEN iteration = n_iter
      THEN concat(text, chr(10), 'FINAL(', replace(substr(text, 1, 20), ')', ''), ')')
      ELSE concat(text, chr(10), '```repl', chr(10), 'x', CAST(turn AS VARCHAR), ' = ',
                  CAST(length(text) AS VARCHAR), chr(10), '```') END AS response,
    CASE WHEN iteration < n_iter
      THEN concat('x', CAST(turn AS VARCHAR), ' = ', CAST(length(text) AS VARCHAR)) END AS code,
    CASE WHEN iteration = n_iter THEN NULL
      WHEN length(text) % 7 = 0 THEN 'ZeroDivisionError: division by zero' ELSE '' END AS stderr,
    CASE WHEN iteration < n_iter THEN CAST(length(text) % 100 AS DOUBLE) / 100 END AS block_seconds,
    CASE WHEN length(text) % 5 > 0 THEN CAST(length(text) % 300 AS DOUBLE) / 100 END AS iteration_time
  FROM (SELECT conv_id AS run_id, turn, text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration,
               count(*) OVER (PARTITION BY conv_id) AS n_iter
        FROM conversations WHERE role = 'assistant') a
)
"""


def _entry(name: str | Column, value: Column) -> Column:
    key = F.lit(name) if isinstance(name, str) else name
    return F.struct(key.alias("key"), value.cast("variant").alias("value"))


def iterations(tables: Tables) -> DataFrame:
    """The runs of ``traj`` in the strict log schema, with messages, blocks, sub-calls and variables."""
    before = tables.conversations.select(
        F.col("conv_id").alias("run_id"),
        (F.col("turn") + 1).alias("turn"),
        F.col("text").alias("asked"),
    )
    rows = traj(tables).join(before, ["run_id", "turn"], "left")
    size = F.length("text")
    system = F.expr(
        """CASE WHEN run_id % 7 = 3 THEN concat('The context variable holds: item ', run_id, '\nEnd.')
           ELSE 'You answer questions.' END"""
    )
    user = F.expr(
        """CASE run_id % 4 WHEN 0 THEN concat('The original query: "q', run_id, '" stands.')
           WHEN 1 THEN concat('Please answer the prompt. ', coalesce(asked, ''))
           ELSE coalesce(asked, '') END"""
    )
    prompt = F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    calls = F.filter(
        F.transform(
            F.array(F.lit(0), F.lit(1)),
            lambda j: F.struct(
                F.concat(F.lit("m"), j.cast("string")).alias("root_model"),
                F.concat(
                    F.lit("p"), j.cast("string"), F.lit(":"), F.substring("text", 1, 10)
                ).alias("prompt"),
                F.substring("text", 1, 5).alias("response"),
                F.create_map(
                    F.concat(F.lit("m"), j.cast("string")),
                    F.struct(
                        F.lit(1).cast("long").alias("total_calls"),
                        (10 * (j + 1)).cast("long").alias("total_input_tokens"),
                        (j + 1).cast("long").alias("total_output_tokens"),
                    ),
                ).alias("usage"),
                (j / 10).cast("double").alias("execution_time"),
            ),
        ),
        lambda c: F.substring(c["root_model"], 2, 1).cast("int") < size % 3,
    ).cast(f"array<{CALL}>")
    variables = F.map_from_entries(
        F.array_compact(
            F.array(
                _entry(F.concat(F.lit("x"), F.col("turn").cast("string")), size.cast("long")),
                _entry("_h", F.lit("h")),
                _entry("f", F.lit("<function 'f'>")),
                F.when(size % 3 == 0, _entry("context", F.expr("substr(text, 1, length(text) % 600 + 1)"))),
            )
        )
    )
    first = F.struct(
        F.col("code"),
        F.struct(
            F.when(size % 2 == 0, F.concat(F.lit("out "), size.cast("string")))
            .otherwise("")
            .alias("stdout"),
            F.col("stderr"),
            variables.alias("locals"),
            F.col("block_seconds").alias("execution_time"),
            calls.alias("rlm_calls"),
        )
        .cast(RESULT)
        .alias("result"),
    ).cast(BLOCK)
    second = F.struct(
        F.lit("y = 1").alias("code"),
        F.struct(
            F.lit("").alias("stdout"),
            F.lit("").alias("stderr"),
            F.create_map().cast("map<string,variant>").alias("locals"),
            F.lit(0.25).alias("execution_time"),
            F.array().cast(f"array<{CALL}>").alias("rlm_calls"),
        ).alias("result"),
    ).cast(BLOCK)
    last = F.col("iteration") == F.col("n_iter")
    blocks = (
        F.when(last, F.array().cast(f"array<{BLOCK}>"))
        .when(size % 4 == 0, F.array(first, second))
        .otherwise(F.array(first))
    )
    return rows.select(
        "run_id",
        "iteration",
        (
            F.timestamp_seconds(F.lit(1704067200) + F.col("run_id") * 60 + F.col("iteration"))
        ).cast("timestamp_ntz").alias("ts"),
        prompt.alias("prompt"),
        "response",
        blocks.alias("code_blocks"),
        F.when(last, F.expr("replace(substr(text, 1, 20), ')', '')")).alias("final_answer"),
        F.when(last & (F.col("run_id") % 2 == 0), F.lit("FINAL")).alias("final_kind"),
        "iteration_time",
    )


MESSAGES_SQL = """
messages AS (
  SELECT t.run_id, t.iteration, 0 AS pos, 'system' AS role,
    CASE WHEN t.run_id % 7 = 3
      THEN 'The context variable holds: item ' || t.run_id || chr(10) || 'End.'
      ELSE 'You answer questions.' END AS content
  FROM traj t
  UNION ALL
  SELECT t.run_id, t.iteration, 1, 'user',
    CASE t.run_id % 4 WHEN 0 THEN 'The original query: "q' || t.run_id || '" stands.'
      WHEN 1 THEN 'Please answer the prompt. ' || coalesce(c.text, '')
      ELSE coalesce(c.text, '') END
  FROM traj t LEFT JOIN conversations c ON c.conv_id = t.run_id AND c.turn = t.turn - 1
)
"""

BLOCKS_SQL = """
blocks AS (
  SELECT run_id, iteration, turn, text, 0 AS block_idx, code,
    CASE WHEN length(text) % 2 = 0 THEN 'out ' || length(text) ELSE '' END AS stdout, stderr,
    block_seconds AS seconds, length(text) % 3 AS n_calls
  FROM traj WHERE code IS NOT NULL
  UNION ALL
  SELECT run_id, iteration, turn, text, 1, 'y = 1', '', '', 0.25, 0
  FROM traj WHERE code IS NOT NULL AND length(text) % 4 = 0
)
"""


def configs(tables: Tables) -> DataFrame:
    """One metadata record per run of ``traj``, none for every tenth run."""
    runs = (
        tables.conversations.where("role = 'assistant' AND conv_id % 10 <> 9")
        .select(F.col("conv_id").alias("run_id"))
        .distinct()
    )
    return runs.select(
        "run_id",
        F.timestamp_seconds(F.lit(1704067200) + F.col("run_id") * 60)
        .cast("timestamp_ntz")
        .alias("ts"),
        F.concat(F.lit("model-"), (F.col("run_id") % 3).cast("string")).alias("root_model"),
        F.lit(1).alias("max_depth"),
        F.lit(30).alias("max_iterations"),
        F.lit("echo").alias("backend"),
        F.map_from_entries(
            F.array(_entry("model_name", F.lit("m")), _entry("timeout", F.col("run_id").cast("long")))
        ).alias("backend_kwargs"),
        F.lit("local").alias("environment_type"),
        F.create_map().cast("map<string,variant>").alias("environment_kwargs"),
        F.array(F.lit("other")).alias("other_backends"),
    )


def run_files(df: DataFrame) -> DataFrame:
    """Replace numeric run ids by log file names."""
    name = F.concat(
        F.lit("chat_2024-01-01_00-00-00_"), F.lower(F.lpad(F.hex("run_id"), 8, "0")), F.lit(".jsonl")
    )
    return df.withColumn("run_id", name)


RUN_FILE_SQL = (
    "'chat_2024-01-01_00-00-00_' || lower(lpad(to_hex({run_id}), 8, '0')) || '.jsonl'"
)


def calls(tables: Tables) -> DataFrame:
    """One row per event, seen as a model call."""
    return tables.events.select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("model"),
        "ts",
        F.col("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )


CALLS_SQL = """
calls AS (
  SELECT event_id AS call_id, user_id AS run_id, event_type AS model, ts, value AS seconds,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
    CAST(floor(value) AS BIGINT) AS output_tokens,
    CASE WHEN event_type = 'error' THEN 'failed' END AS error
  FROM events
)
"""


def variables(tables: Tables) -> DataFrame:
    """Events seen as assignments: run_id, name, value, ts, event_id."""
    return tables.events.select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "error", "_error")
        .otherwise(F.col("event_type"))
        .alias("name"),
        F.when(F.col("event_id") % 11 == 0, F.lit("<module 'm'>"))
        .when(F.col("event_id") % 13 == 0, F.lit("<b>1</b>"))
        .when(F.col("event_id") % 17 == 0, F.lit(None))
        .otherwise(F.get_json_object("props", "$.k"))
        .alias("value"),
        "ts",
        "event_id",
    )


VARS_SQL = """
vars AS (
  SELECT user_id AS run_id, CASE WHEN event_type = 'error' THEN '_error' ELSE event_type END AS name,
    CASE WHEN event_id % 11 = 0 THEN '<module ''m''>' WHEN event_id % 13 = 0 THEN '<b>1</b>'
      WHEN event_id % 17 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS value,
    ts, event_id
  FROM events
)
"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"
