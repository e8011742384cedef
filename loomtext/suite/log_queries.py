"""Run logs: reading, writing, flattening, rolling up, history and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions.extract import code_blocks, final_answer
from loomtext.functions.messages import iteration_messages, render_execution, visible_names
from loomtext.operators.history import append_history, assemble_prompts, history_of, prompt_growth
from loomtext.operators.trajectories import (
    context_question,
    context_variable,
    explode_code_blocks,
    explode_locals,
    explode_messages,
    explode_subcalls,
    final_answers,
    iteration_stats,
    number_iterations,
    recent_runs,
    run_summary,
)
from loomtext.operators.usage import usage_by_model, usage_of_subcalls
from loomtext.scratch import materialise, scratch_path
from loomtext.sources.runlogs import (
    bad_lines,
    configs_of,
    iterations_of,
    parse_log_lines,
    read_log_lines,
    read_trajectories,
    run_config,
    run_identity,
    upsert_runs,
    write_trajectories,
)
from loomtext.suite.fixtures import (
    BLOCKS_SQL,
    MESSAGES_SQL,
    RUN_FILE_SQL,
    TRAJ_SQL,
    configs,
    iterations,
    run_files,
    traj,
    with_ctes,
)
from loomtext.suite.registry import query


def write_logs(t, packed: bool = True) -> str:
    """The derived runs as log files in a new folder."""
    path = scratch_path(t.spark, "logs")
    write_trajectories(run_files(configs(t)), run_files(iterations(t)), path, packed)
    return path


SECONDS_SQL = """
stats AS (
  SELECT t.run_id, t.iteration, t.n_iter, t.response, t.text, count(b.block_idx) AS n_blocks,
    CAST(coalesce(sum(b.n_calls), 0) AS BIGINT) AS n_calls,
    round(coalesce(max(t.iteration_time), sum(b.seconds), 0), 4) AS seconds,
    coalesce(bool_or(b.stderr <> ''), false) AS has_error, t.iteration = t.n_iter AS has_final
  FROM traj t LEFT JOIN blocks b ON b.run_id = t.run_id AND b.iteration = t.iteration
  GROUP BY ALL
)
"""

STATS_SQL = (
    with_ctes(TRAJ_SQL, BLOCKS_SQL, MESSAGES_SQL, SECONDS_SQL)
    + """
    SELECT {run} AS run_id, s.iteration, n_blocks, n_calls, seconds, has_error, has_final,
      CAST((m.n + 2) // 4 AS BIGINT) AS input_tokens, CAST((length(response) + 2) // 4 AS BIGINT) AS output_tokens,
      CASE WHEN has_final THEN 'final' WHEN has_error THEN 'error' ELSE 'plain' END AS status
    FROM stats s JOIN (SELECT run_id, iteration, sum(length(content)) AS n FROM messages GROUP BY 1, 2) m
      ON m.run_id = s.run_id AND m.iteration = s.iteration
    """
)


def _rounded_stats(rows):
    return iteration_stats(rows).withColumn("seconds", F.round("seconds", 4))


@query("agg4_iteration_stats", STATS_SQL.format(run="s.run_id"))
def agg4(t):
    return _rounded_stats(iterations(t))


@query("src4_read_trajectories", STATS_SQL.format(run=RUN_FILE_SQL.format(run_id="s.run_id")))
def src4(t):
    _, rows, _ = read_trajectories(t.spark, write_logs(t))
    return _rounded_stats(rows)


@query(
    "snk1_write_trajectories",
    with_ctes(TRAJ_SQL)
    + f"""
    SELECT {RUN_FILE_SQL.format(run_id="run_id")} AS run_id, 'iteration' AS kind, count(*) AS n_lines,
      CAST(max(iteration) AS BIGINT) AS last_line FROM traj GROUP BY run_id
    UNION ALL
    SELECT DISTINCT {RUN_FILE_SQL.format(run_id="run_id")}, 'metadata', 1, NULL FROM traj WHERE run_id % 10 <> 9
    """,
)
def snk1(t):
    lines = parse_log_lines(read_log_lines(t.spark, write_logs(t, packed=False)))
    return lines.groupBy("run_id", F.col("record.type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("record.iteration").cast("long").alias("last_line"),
    )


@query(
    "snk1_write_packed",
    with_ctes(TRAJ_SQL)
    + f"""
    SELECT {RUN_FILE_SQL.format(run_id="run_id")} AS run_id, count(*) AS n_iterations,
      CAST(sum(length(response)) AS BIGINT) AS n_chars FROM traj GROUP BY run_id
    """,
)
def snk1_packed(t):
    _, rows, _ = read_trajectories(t.spark, write_logs(t))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_iterations"),
        F.sum(F.length("response").cast("long")).alias("n_chars"),
    )


@query(
    "src5_run_identity",
    with_ctes(TRAJ_SQL)
    + f"""
    SELECT DISTINCT {RUN_FILE_SQL.format(run_id="run_id")} AS run_id, 'chat' AS name,
      CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) AS started, lower(lpad(to_hex(run_id), 8, '0')) AS suffix
    FROM traj
    """,
)
def src5(t):
    files = read_log_lines(t.spark, write_logs(t, packed=False)).select("file_path").distinct()
    identity = files.select(run_identity(F.col("file_path")).alias("r")).select("r.*").distinct()
    return identity.withColumn("started", F.unix_timestamp(F.col("started").cast("timestamp")))


@query(
    "prj1_split_records",
    with_ctes(TRAJ_SQL)
    + """
    SELECT 'iteration' AS kind, count(*) AS n FROM traj
    UNION ALL SELECT 'metadata', count(DISTINCT run_id) FROM traj WHERE run_id % 10 <> 9
    UNION ALL SELECT 'bad', count(DISTINCT run_id) FROM traj
    """,
)
def prj1(t):
    # Written, as the files would be read again for each of the uses below.
    lines = materialise(read_log_lines(t.spark, write_logs(t, packed=False)), "log-lines")
    # One broken and one blank line per run beside the good ones.
    runs = lines.select("file_path").distinct()
    broken = runs.select(F.lit('{"type": "iteration", ').alias("line"), "file_path")
    blank = runs.select(F.lit("  ").alias("line"), "file_path")
    parsed = parse_log_lines(lines.unionByName(broken).unionByName(blank))

    def counted(rows, kind):
        # A distinct run per bad line, as a run's log may be split over several files.
        return rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))

    return (
        counted(iterations_of(parsed), "iteration")
        .unionByName(counted(configs_of(parsed), "metadata"))
        .unionByName(counted(bad_lines(parsed).select("run_id").distinct(), "bad"))
    )


@query(
    "prj11_run_config",
    with_ctes(TRAJ_SQL)
    + f"""
    SELECT DISTINCT {RUN_FILE_SQL.format(run_id="run_id")} AS run_id,
      CASE WHEN run_id % 10 <> 9 THEN 'model-' || (run_id % 3) END AS root_model,
      CASE WHEN run_id % 10 <> 9 THEN 30 END AS max_iterations,
      CASE WHEN run_id % 10 <> 9 THEN 'm' END AS model_name,
      CASE WHEN run_id % 10 <> 9 THEN CAST(run_id AS BIGINT) END AS timeout,
      CASE WHEN run_id % 10 <> 9 THEN 'other' END AS others
    FROM traj
    """,
)
def prj11(t):
    found, rows, _ = read_trajectories(t.spark, write_logs(t))
    config = run_config(found, rows.select("run_id").distinct())
    kwargs = F.col("backend_kwargs")
    return config.select(
        "run_id",
        "root_model",
        "max_iterations",
        F.try_variant_get(kwargs["model_name"], "$", "string").alias("model_name"),
        F.try_variant_get(kwargs["timeout"], "$", "long").alias("timeout"),
        F.array_join("other_backends", ",").alias("others"),
    )


UPSERT_SQL = """
    SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, round(arg_max(value, event_id), 4) AS value
    FROM events GROUP BY 1, 2
"""


@query("snk2_upsert_runs", UPSERT_SQL)
def snk2(t):
    rows = t.events.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))
    half = rows.agg(F.max("event_id")).first()[0] // 2
    existing, new = rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half)
    return upsert_runs(existing, new, ["user_id", "event_type"], "event_id")


@query(
    "prj7_explode_messages",
    with_ctes(TRAJ_SQL, MESSAGES_SQL)
    + """
    SELECT run_id, iteration, CAST(pos AS BIGINT) AS pos, role, content,
           role = 'user' AND pos > 0 AS is_continuation FROM messages
    """,
)
def prj7(t):
    return explode_messages(iterations(t))


@query(
    "prj8_explode_code_blocks",
    with_ctes(TRAJ_SQL, BLOCKS_SQL)
    + """
    SELECT t.run_id, t.iteration, CAST(b.block_idx AS BIGINT) AS block_idx, b.code, b.stdout, b.stderr,
      round(b.seconds, 4) AS execution_time, CAST(coalesce(b.n_calls, 0) AS BIGINT) AS n_calls,
      CASE WHEN b.block_idx IS NULL THEN NULL WHEN b.stderr <> '' THEN 'error' WHEN b.stdout <> '' THEN 'output' ELSE 'none' END AS status
    FROM traj t LEFT JOIN blocks b ON b.run_id = t.run_id AND b.iteration = t.iteration
    """,
)
def prj8(t):
    blocks = explode_code_blocks(iterations(t))
    return blocks.withColumn("execution_time", F.round("execution_time", 4))


SUBCALLS_SQL = """
subcalls AS (
  SELECT run_id, iteration, block_idx, j, 'm' || j AS root_model, 'p' || j || ':' || substr(text, 1, 10) AS prompt,
    substr(text, 1, 5) AS response, 10 * (j + 1) AS input_tokens, j + 1 AS output_tokens, j / 10 AS execution_time
  FROM (SELECT *, unnest(range(CAST(n_calls AS BIGINT))) AS j FROM blocks)
)
"""


@query(
    "prj9_explode_subcalls",
    with_ctes(TRAJ_SQL, BLOCKS_SQL, SUBCALLS_SQL)
    + """
    SELECT run_id, iteration, CAST(block_idx AS BIGINT) AS block_idx, CAST(j AS BIGINT) AS call_idx, root_model, prompt,
      response, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, round(execution_time, 4) AS execution_time
    FROM subcalls
    """,
)
def prj9(t):
    usage = F.col("usage")[F.col("root_model")]
    return explode_subcalls(iterations(t)).select(
        "run_id",
        "iteration",
        "block_idx",
        "call_idx",
        "root_model",
        "prompt",
        "response",
        usage["total_input_tokens"].alias("input_tokens"),
        usage["total_output_tokens"].alias("output_tokens"),
        F.round("execution_time", 4).alias("execution_time"),
    )


@query(
    "agg1_usage_of_subcalls",
    with_ctes(TRAJ_SQL, BLOCKS_SQL, SUBCALLS_SQL)
    + """
    SELECT root_model AS model, count(*) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
      CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens
    FROM subcalls GROUP BY 1
    """,
)
def agg1_subcalls(t):
    return usage_by_model(usage_of_subcalls(explode_subcalls(iterations(t))))


LOCALS_SQL = """
locals AS (
  SELECT run_id, iteration, block_idx, 'x' || turn AS name, CAST(length(text) AS VARCHAR) AS value FROM blocks WHERE block_idx = 0
  UNION ALL SELECT run_id, iteration, block_idx, '_h', 'h' FROM blocks WHERE block_idx = 0
  UNION ALL SELECT run_id, iteration, block_idx, 'f', '<function ''f''>' FROM blocks WHERE block_idx = 0
  UNION ALL SELECT run_id, iteration, block_idx, 'context', substr(text, 1, length(text) % 600 + 1)
  FROM blocks WHERE block_idx = 0 AND length(text) % 3 = 0
)
"""


@query(
    "prj10_explode_locals",
    with_ctes(TRAJ_SQL, BLOCKS_SQL, LOCALS_SQL)
    + "SELECT run_id, iteration, CAST(block_idx AS BIGINT) AS block_idx, name, value AS value_text FROM locals",
)
def prj10(t):
    return explode_locals(iterations(t)).drop("value")


QUESTION_SQL = """
first_context AS (
  SELECT run_id, arg_min(value, iteration) AS context FROM locals
  WHERE name = 'context' AND length(value) < 500 GROUP BY 1),
user_message AS (
  SELECT run_id, content AS c FROM messages WHERE iteration = 1 AND role = 'user'),
question AS (
  SELECT u.run_id, coalesce(
    CASE WHEN regexp_matches(c, 'original query: "[^"]+"') THEN regexp_extract(c, 'original query: "([^"]+)"', 1)
      WHEN NOT contains(c, 'answer the prompt') AND length(c) > 50 AND length(c) < 500
        THEN substr(c, 1, 200) || CASE WHEN length(c) > 200 THEN '...' ELSE '' END END,
    CASE WHEN u.run_id % 7 = 3 THEN 'item ' || u.run_id END,
    context, 'Context available in REPL environment') AS question
  FROM user_message u LEFT JOIN first_context f ON f.run_id = u.run_id)
"""


@query(
    "agg7_context_question",
    with_ctes(TRAJ_SQL, MESSAGES_SQL, BLOCKS_SQL, LOCALS_SQL, QUESTION_SQL)
    + "SELECT run_id, question FROM question",
)
def agg7(t):
    return context_question(iterations(t))


@query(
    "agg8_context_variable",
    with_ctes(TRAJ_SQL, BLOCKS_SQL, LOCALS_SQL)
    + "SELECT run_id, arg_min(value, iteration) AS context FROM locals WHERE name = 'context' GROUP BY 1",
)
def agg8(t):
    return context_variable(iterations(t))


FINAL_SQL = """
finals AS (
  SELECT run_id, replace(substr(text, 1, 20), ')', '') AS final_answer FROM traj
  WHERE iteration = n_iter AND (run_id % 2 = 0 OR replace(substr(text, 1, 20), ')', '') <> ''))
"""


@query(
    "agg6_final_answers",
    with_ctes(TRAJ_SQL, FINAL_SQL) + "SELECT run_id, final_answer FROM finals",
)
def agg6(t):
    return final_answers(iterations(t))


SUMMARY_SQL = (
    with_ctes(
        TRAJ_SQL, BLOCKS_SQL, MESSAGES_SQL, LOCALS_SQL, QUESTION_SQL, FINAL_SQL, SECONDS_SQL
    )
    + """
    SELECT s.run_id, count(*) AS n_iterations, CAST(sum(n_blocks) AS BIGINT) AS n_blocks, CAST(sum(n_calls) AS BIGINT) AS n_calls,
      round(sum(seconds), 4) AS seconds, bool_or(has_error) AS has_errors, max(q.question) AS question,
      max(f.final_answer) AS final_answer, coalesce(max(f.final_answer) <> '', false) AS completed
    FROM stats s JOIN question q ON q.run_id = s.run_id LEFT JOIN finals f ON f.run_id = s.run_id
    GROUP BY s.run_id
    """
)


@query("agg5_run_summary", SUMMARY_SQL)
def agg5(t):
    return run_summary(iterations(t)).withColumn("seconds", F.round("seconds", 4))


@query(
    "top1_recent_runs",
    with_ctes(TRAJ_SQL, FINAL_SQL)
    + """
    SELECT t.run_id, count(*) AS n_iterations, coalesce(max(f.final_answer) <> '', false) AS completed
    FROM traj t LEFT JOIN finals f ON f.run_id = t.run_id GROUP BY 1 ORDER BY t.run_id DESC LIMIT 10
    """,
)
def top1(t):
    rows = iterations(t)
    started = rows.groupBy("run_id").agg(F.min("ts").alias("started"))
    summaries = run_summary(rows).join(started, "run_id")
    return recent_runs(summaries, "started").select("run_id", "n_iterations", "completed")


EXECUTED_SQL = """
executed AS (
  SELECT b.*, CASE WHEN block_idx = 0
      THEN 'REPL variables: [''x' || turn || '''' || CASE WHEN length(text) % 3 = 0 THEN ', ''context''' ELSE '' END || ']' || chr(10) END AS names
  FROM blocks b),
rendered AS (
  SELECT *, coalesce(nullif(concat_ws(chr(10) || chr(10), CASE WHEN stdout <> '' THEN chr(10) || stdout END,
      CASE WHEN stderr <> '' THEN chr(10) || stderr END, names), ''), 'No output') AS shown FROM executed),
added AS (
  SELECT run_id, iteration, CAST(0 AS BIGINT) AS seq, 'assistant' AS role, response AS content FROM traj
  UNION ALL
  SELECT run_id, iteration, block_idx + 1, 'user', 'Code executed:' || chr(10) || '```python' || chr(10) || code || chr(10) || '```'
    || chr(10) || chr(10) || 'REPL output:' || chr(10) || shown FROM rendered)
"""


@query(
    "ext3_render_execution",
    with_ctes(TRAJ_SQL, BLOCKS_SQL, EXECUTED_SQL)
    + "SELECT run_id, iteration, CAST(block_idx AS BIGINT) AS block_idx, shown FROM rendered",
)
def ext3(t):
    blocks = iterations(t).select(
        "run_id", "iteration", F.posexplode("code_blocks").alias("block_idx", "block")
    )
    result = F.col("block.result")
    return blocks.select(
        "run_id",
        "iteration",
        F.col("block_idx").cast("long").alias("block_idx"),
        render_execution(
            result["stdout"], result["stderr"], visible_names(result["locals"])
        ).alias("shown"),
    )


@query(
    "ext4_format_iterations",
    with_ctes(TRAJ_SQL, BLOCKS_SQL, EXECUTED_SQL)
    + """
    SELECT run_id, iteration, count(*) AS n_messages, md5(string_agg(role || ':' || content, '|' ORDER BY seq)) AS digest
    FROM added GROUP BY 1, 2
    """,
)
def ext4(t):
    added = iteration_messages(F.col("response"), F.col("code_blocks"))
    joined = F.array_join(
        F.transform(added, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
    )
    return iterations(t).select(
        "run_id",
        "iteration",
        F.size(added).cast("long").alias("n_messages"),
        F.md5(joined).alias("digest"),
    )


@query(
    "ext1_extract_code_blocks",
    with_ctes(TRAJ_SQL)
    + r"""
    SELECT run_id, iteration, CAST(i AS BIGINT) AS block_idx, trim(b[i + 1]) AS code
    FROM (SELECT run_id, iteration, b, unnest(range(len(b))) AS i
          FROM (SELECT run_id, iteration, regexp_extract_all(response, '(?s)```repl\s*\n(.*?)\n```', 1) AS b FROM traj))
    """,
)
def ext1(t):
    blocks = traj(t).select(
        "run_id",
        "iteration",
        F.posexplode(code_blocks(F.col("response"))).alias("block_idx", "code"),
    )
    return blocks.withColumn("block_idx", F.col("block_idx").cast("long"))


@query(
    "ext2_extract_final",
    r"""
    WITH r AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN chr(10) || '  FINAL(' || role || ' (' || turn || '))'
        WHEN 1 THEN chr(10) || 'FINAL(a)' || chr(10) || 'FINAL_VAR( v' || turn || ' )' ELSE ' FINAL(no)' END AS x FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(x, '(?sm)^\s*FINAL_VAR\((.*?)\)') THEN 'FINAL_VAR'
        WHEN regexp_matches(x, '(?sm)^\s*FINAL\((.*?)\)') THEN 'FINAL' END AS kind,
      CASE WHEN regexp_matches(x, '(?sm)^\s*FINAL_VAR\((.*?)\)') THEN trim(regexp_extract(x, '(?sm)^\s*FINAL_VAR\((.*?)\)', 1))
        WHEN regexp_matches(x, '(?sm)^\s*FINAL\((.*?)\)') THEN trim(regexp_extract(x, '(?sm)^\s*FINAL\((.*?)\)', 1)) END AS content
    FROM r
    """,
)
def ext2(t):
    response = F.expr(
        r"""concat(text, CASE turn % 3 WHEN 0 THEN concat('\n  FINAL(', role, ' (', turn, '))')
            WHEN 1 THEN concat('\nFINAL(a)\nFINAL_VAR( v', turn, ' )') ELSE ' FINAL(no)' END)"""
    )
    answered = t.conversations.select("conv_id", "turn", final_answer(response).alias("a"))
    return answered.select("conv_id", "turn", "a.kind", "a.content")


@query(
    "win1_message_history",
    with_ctes(TRAJ_SQL, BLOCKS_SQL, EXECUTED_SQL)
    + """
    SELECT t.run_id, t.iteration, count(a.seq) AS n_messages,
      md5(coalesce(string_agg(a.role || ':' || a.content, '|' ORDER BY a.iteration, a.seq), '')) AS digest
    FROM traj t LEFT JOIN added a ON a.run_id = t.run_id AND a.iteration < t.iteration
    WHERE t.iteration = t.n_iter GROUP BY 1, 2
    """,
)
def win1(t):
    rows = iterations(t)
    due = rows.groupBy("run_id").agg(F.max("iteration").alias("iteration"))
    prompts = assemble_prompts(history_of(rows), due)
    joined = F.array_join(
        F.transform("prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
    )
    return prompts.select(
        "run_id",
        "iteration",
        F.size("prompt").cast("long").alias("n_messages"),
        F.md5(joined).alias("digest"),
    )


@query(
    "win1_prompt_growth",
    with_ctes(TRAJ_SQL, BLOCKS_SQL, EXECUTED_SQL)
    + """
    , g AS (SELECT run_id, iteration, count(*) AS n, sum(length(content)) AS c FROM added GROUP BY 1, 2)
    SELECT run_id, iteration,
      CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS messages_before, CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) AS chars_before
    FROM g WINDOW w AS (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """,
)
def win1_growth(t):
    return prompt_growth(history_of(iterations(t)))


@query(
    "win2_number_iterations",
    """
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration
    FROM conversations WHERE role = 'assistant'
    """,
)
def win2(t):
    turns = t.conversations.where("role = 'assistant'").select("conv_id", "turn")
    return number_iterations(turns, "conv_id", ["turn"])


@query(
    "win2_sliced",
    """
    SELECT event_type, event_id, row_number() OVER (
             PARTITION BY event_type ORDER BY props DESC, ts, event_id) AS iteration
    FROM events
    """,
)
def win2_sliced(t):
    """Five long runs, ordered by a text that repeats, then a time: every run lies in several partitions."""
    events = t.events.select("event_type", "props", "ts", "event_id")
    numbered = number_iterations(events, "event_type", ["-props", "ts", "event_id"], slice_rows=1_000)
    return numbered.select("event_type", "event_id", "iteration")


@query(
    "set2_append_history",
    """
    SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
      SELECT role, text FROM conversations WHERE turn < 4 UNION ALL
      SELECT role, text FROM conversations WHERE turn >= 2) GROUP BY 1
    """,
)
def set2(t):
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    history = append_history(turns.where("turn < 4"), turns.where("turn >= 2"))
    return history.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("n_chars")
    )
