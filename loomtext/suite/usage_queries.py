"""Token usage, variables and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators.usage import last_usage, merge_usage, usage_by_model, usage_totals
from loomtext.operators.variables import (
    latest_variables,
    redact_config,
    resolve_answers,
    serialise_values,
    user_variables,
    all_variables_as_of,
    variables_as_of,
)
from loomtext.suite.fixtures import CALLS_SQL, VARS_SQL, calls, variables, with_ctes
from loomtext.suite.registry import query

TOTALS_SQL = """count(*) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
  CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens"""


@query(
    "agg1_usage_by_model",
    with_ctes(CALLS_SQL) + f"SELECT model, {TOTALS_SQL} FROM calls GROUP BY 1",
)
def agg1(t):
    return usage_by_model(calls(t))


@query(
    "agg2_usage_totals",
    with_ctes(CALLS_SQL)
    + f"""
    SELECT run_id, model, CAST(grouping_id(run_id, model) AS BIGINT) AS level, {TOTALS_SQL}
    FROM calls GROUP BY ROLLUP (run_id, model)
    """,
)
def agg2(t):
    return usage_totals(calls(t))


@query(
    "agg3_last_usage",
    with_ctes(CALLS_SQL)
    + """
    SELECT model, arg_max(input_tokens, (ts, call_id)) AS input_tokens, arg_max(output_tokens, (ts, call_id)) AS output_tokens
    FROM calls GROUP BY 1
    """,
)
def agg3(t):
    return last_usage(calls(t), ["ts", "call_id"])


def _halves(t):
    rows = calls(t)
    return usage_by_model(rows.where("call_id % 2 = 0")), usage_by_model(
        rows.where("call_id % 2 = 1 AND model <> 'view'")
    )


@query(
    "set1_merge_usage_sum",
    with_ctes(CALLS_SQL)
    + f"SELECT model, {TOTALS_SQL} FROM calls WHERE call_id % 2 = 0 OR model <> 'view' GROUP BY 1",
)
def set1(t):
    return merge_usage(*_halves(t))


@query(
    "set1_merge_usage_last",
    with_ctes(CALLS_SQL)
    + f"""
    SELECT model, {TOTALS_SQL} FROM calls
    WHERE call_id % 2 = CASE WHEN model = 'view' THEN 0 ELSE 1 END GROUP BY 1
    """,
)
def set1_last(t):
    return merge_usage(*_halves(t), mode="last")


@query(
    "flt1_user_variables",
    with_ctes(VARS_SQL)
    + """
    SELECT run_id, name, value, event_id FROM vars
    WHERE NOT starts_with(name, '_') AND value IS NOT NULL
      AND NOT regexp_matches(value, '^<(module|function|type|method|builtin_function_or_method) ''.*''>$')
    """,
)
def flt1(t):
    return user_variables(variables(t)).select("run_id", "name", "value", "event_id")


@query(
    "win4_latest_variables",
    with_ctes(VARS_SQL)
    + "SELECT run_id, name, arg_max_null(value, (ts, event_id)) AS value FROM vars GROUP BY 1, 2",
)
def win4(t):
    return latest_variables(variables(t), ["ts", "event_id"])


@query(
    "win4_variables_as_of",
    with_ctes(VARS_SQL)
    + """
    SELECT m.run_id, m.event_id, 'purchase' AS name, a.value
    FROM vars m ASOF LEFT JOIN (SELECT run_id, ts, value FROM vars WHERE name = 'purchase') a
      ON m.run_id = a.run_id AND m.ts >= a.ts
    """,
)
def win4_as_of(t):
    rows = variables(t)
    moments = rows.select("run_id", "ts", "event_id")
    return variables_as_of(rows, moments, "purchase", ["ts", "event_id"]).select(
        "run_id", "event_id", "name", "value"
    )


@query(
    "win4_all_variables",
    with_ctes(VARS_SQL)
    + """
    , crossed AS (
      SELECT m.run_id, m.ts, m.event_id, n.name, CASE WHEN m.name = n.name THEN m.event_id END AS set_at
      FROM vars m JOIN (SELECT DISTINCT run_id, name FROM vars) n USING (run_id)),
    held AS (
      SELECT run_id, event_id, name, last_value(set_at IGNORE NULLS) OVER (
               PARTITION BY run_id, name ORDER BY ts, event_id) AS set_at FROM crossed)
    SELECT h.run_id, h.event_id, h.name, v.value
    FROM held h JOIN vars v ON v.event_id = h.set_at
    """,
)
def win4_all(t):
    rows = variables(t)
    moments = rows.select("run_id", "ts", "event_id")
    return all_variables_as_of(rows, moments, ["ts", "event_id"]).select(
        "run_id", "event_id", "name", "value"
    )


@query(
    "jn2_resolve_answers",
    with_ctes(VARS_SQL)
    + """
    , latest AS (SELECT run_id, name, arg_max_null(value, (ts, event_id)) AS value FROM vars GROUP BY 1, 2),
    a AS (SELECT DISTINCT run_id, CASE WHEN run_id % 5 = 0 THEN 'FINAL' ELSE 'FINAL_VAR' END AS kind,
            CASE WHEN run_id % 2 = 0 THEN 'purchase' ELSE 'nonexistent' END AS wanted FROM vars)
    SELECT a.run_id, a.kind, CASE WHEN a.kind = 'FINAL_VAR' THEN a.wanted END AS name,
      CASE WHEN a.kind = 'FINAL' THEN CASE a.run_id % 3 WHEN 0 THEN ' ' || wanted || ' ' WHEN 1 THEN '"' || wanted || '"' ELSE '''' || wanted || '''' END
        ELSE l.value END AS answer,
      CASE WHEN a.kind = 'FINAL_VAR' AND l.name IS NULL THEN 'Error: Variable ''' || wanted || ''' not found' END AS error
    FROM a LEFT JOIN latest l ON l.run_id = a.run_id AND l.name = a.wanted AND a.kind = 'FINAL_VAR'
    """,
)
def jn2(t):
    rows = variables(t)
    wanted = "CASE WHEN run_id % 2 = 0 THEN 'purchase' ELSE 'nonexistent' END"
    answers = rows.select(
        "run_id",
        F.expr("CASE WHEN run_id % 5 = 0 THEN 'FINAL' ELSE 'FINAL_VAR' END").alias("kind"),
        F.expr(
            f"""CASE run_id % 3 WHEN 0 THEN concat(' ', {wanted}, ' ')
                WHEN 1 THEN concat('"', {wanted}, '"') ELSE concat("'", {wanted}, "'") END"""
        ).alias("content"),
    ).distinct()
    return resolve_answers(answers, latest_variables(rows, ["ts", "event_id"])).drop("content")


@query(
    "prj2_redact_config",
    """
    SELECT c_custkey, 'model,token' AS names, c_mktsegment || ',' || c_name AS kept FROM customer
    """,
)
def prj2(t):
    config = t.customer.select(
        "c_custkey",
        F.create_map(
            F.lit("API_KEY"),
            "c_name",
            F.lit("model"),
            "c_mktsegment",
            F.lit("key_for_api"),
            "c_name",
            F.lit("token"),
            "c_name",
        ).alias("config"),
    )
    redacted = redact_config(config, "config")
    return redacted.select(
        "c_custkey",
        F.array_join(F.map_keys("config"), ",").alias("names"),
        F.array_join(F.map_values("config"), ",").alias("kept"),
    )


@query(
    "ext7_serialise_values",
    """
    SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || ',"nested":["' || c_mktsegment || '"],"none":null}' AS variables
    FROM customer
    """,
)
def ext7(t):
    held = t.customer.select(
        "c_custkey",
        F.create_map(
            F.lit("name"),
            F.col("c_name").cast("variant"),
            F.lit("nation"),
            F.col("c_nationkey").cast("variant"),
            F.lit("nested"),
            F.array("c_mktsegment").cast("variant"),
            F.lit("none"),
            F.parse_json(F.lit("null")),
        ).alias("variables"),
    )
    return serialise_values(held, "variables")
