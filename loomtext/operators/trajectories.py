"""Flatten run logs and roll them up. Iterations carry the strict log schema, one row each.

Per-iteration figures come from array functions on the row itself; a run costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import message_characters, strip_blanks, tokens_of_length, truncate_text
from loomtext.operators.ordering import SLICE_ROWS, ordered_scan, row_number

# Phrases the question search looks for, and its last resort.
QUOTED_QUESTION = r'original query: "([^"]+)"'
GENERAL_PROMPT = "answer the prompt"
SYSTEM_CONTEXT = r"(?iu)context variable[^\n\r  ]*?:([^\n\r  ]*?)(?:\n|\z)"
NO_QUESTION = "Context available in REPL environment"


def explode_messages(iterations: DataFrame) -> DataFrame:
    """One row per prompt message; a user message after the first position is a continuation."""
    return iterations.select(
        "run_id", "iteration", F.posexplode("prompt").alias("pos", "message")
    ).select(
        "run_id",
        "iteration",
        F.col("pos").cast("long").alias("pos"),
        F.col("message.role").alias("role"),
        F.col("message.content").alias("content"),
        ((F.col("message.role") == "user") & (F.col("pos") > 0)).alias("is_continuation"),
    )


def explode_code_blocks(iterations: DataFrame) -> DataFrame:
    """One row per code block, and one with NULLs for an iteration without any."""
    blocks = iterations.select(
        "run_id", "iteration", F.posexplode_outer("code_blocks").alias("block_idx", "block")
    )
    status = (
        F.when(F.col("block").isNull(), None)
        .when(F.col("stderr") != "", "error")
        .when(F.col("stdout") != "", "output")
        .otherwise("none")
    )
    return blocks.select(
        "run_id",
        "iteration",
        F.col("block_idx").cast("long").alias("block_idx"),
        F.col("block"),
        F.col("block.code").alias("code"),
        F.col("block.result.stdout").alias("stdout"),
        F.col("block.result.stderr").alias("stderr"),
        F.col("block.result.execution_time").alias("execution_time"),
        F.coalesce(F.array_size(F.col("block.result.rlm_calls")), F.lit(0)).cast("long").alias("n_calls"),
    ).select("*", status.alias("status")).drop("block")


def explode_subcalls(iterations: DataFrame) -> DataFrame:
    """One row per model call made by a code block."""
    return (
        iterations.select(
            "run_id", "iteration", F.posexplode("code_blocks").alias("block_idx", "block")
        )
        .select(
            "run_id",
            "iteration",
            F.col("block_idx").cast("long").alias("block_idx"),
            F.posexplode("block.result.rlm_calls").alias("call_idx", "call"),
        )
        .select(
            "run_id",
            "iteration",
            "block_idx",
            F.col("call_idx").cast("long").alias("call_idx"),
            "call.*",
        )
    )


def explode_locals(iterations: DataFrame) -> DataFrame:
    """One row per variable after a block: its VARIANT value and its text (JSON unless text)."""
    return (
        iterations.select(
            "run_id", "iteration", F.posexplode("code_blocks").alias("block_idx", "block")
        )
        .select(
            "run_id",
            "iteration",
            F.col("block_idx").cast("long").alias("block_idx"),
            F.explode("block.result.locals").alias("name", "value"),
        )
        .withColumn(
            "value_text",
            F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")),
        )
    )


def _block_sum(value) -> Column:
    amounts = F.transform("code_blocks", lambda b: F.coalesce(value(b), F.lit(0.0)))
    return F.aggregate(amounts, F.lit(0.0), lambda total, x: total + x)


def iteration_stats(iterations: DataFrame) -> DataFrame:
    """Figures of each iteration, computed on the row itself (no shuffle)."""
    seconds = F.coalesce("iteration_time", _block_sum(lambda b: b["result"]["execution_time"]))
    sub_calls = _block_sum(lambda b: F.array_size(b["result"]["rlm_calls"]).cast("double"))
    has_error = F.exists(
        "code_blocks", lambda b: F.coalesce(b["result"]["stderr"] != "", F.lit(False))
    )
    stats = iterations.select(
        "run_id",
        "iteration",
        F.size("code_blocks").cast("long").alias("n_blocks"),
        sub_calls.cast("long").alias("n_calls"),
        seconds.alias("seconds"),
        has_error.alias("has_error"),
        F.col("final_answer").isNotNull().alias("has_final"),
        tokens_of_length(message_characters(F.col("prompt"))).alias("input_tokens"),
        tokens_of_length(F.length("response")).alias("output_tokens"),
    )
    status = (
        F.when(F.col("has_final"), "final").when(F.col("has_error"), "error").otherwise("plain")
    )
    return stats.withColumn("status", status)


def _first_of(candidates: Column) -> Column:
    return F.get(F.filter(candidates, lambda c: c.isNotNull()), F.lit(0))


def question_in_prompt(prompt: Column) -> Column:
    """Question of the first user message that yields one: a quoted query, or the text itself when it
    is 51 to 499 characters and not the general prompt; else the line a system message gives."""

    def from_user(m: Column) -> Column:
        quoted = F.regexp_extract(m["content"], QUOTED_QUESTION, 1)
        length = F.length(m["content"])
        return F.when(
            m["role"] == "user",
            F.when(quoted != "", quoted).when(
                ~F.contains(m["content"], F.lit(GENERAL_PROMPT)) & (length > 50) & (length < 500),
                truncate_text(m["content"], 200),
            ),
        )

    system = F.get(F.filter(prompt, lambda m: m["role"] == "system"), F.lit(0))["content"]
    found = F.regexp_extract(system, SYSTEM_CONTEXT, 0)
    line = F.when(
        found != "",
        F.substring(strip_blanks(F.regexp_extract(system, SYSTEM_CONTEXT, 1)), 1, 200),
    )
    return F.coalesce(_first_of(F.transform(prompt, from_user)), line)


def context_in_blocks(blocks: Column, below: int | None = None) -> Column:
    """First non-empty text value of a variable named ``context``, optionally of limited length."""

    def text_of(block: Column) -> Column:
        value = block["result"]["locals"]["context"]
        is_text = F.schema_of_variant(value) == "STRING"
        text = F.when(is_text, F.try_variant_get(value, "$", "string"))
        wanted = text != ""
        if below is not None:
            wanted = wanted & (F.length(text) < below)
        return F.when(wanted, text)

    return _first_of(F.transform(blocks, text_of))


def context_question(iterations: DataFrame) -> DataFrame:
    """Best-effort question of each run; only the first iteration's prompt is searched."""
    candidates = iterations.select(
        "run_id",
        "iteration",
        question_in_prompt(F.col("prompt")).alias("_asked"),
        context_in_blocks(F.col("code_blocks"), below=500).alias("_context"),
    )
    return candidates.groupBy("run_id").agg(_question().alias("question"))


def _question() -> Column:
    asked = F.min_by(F.struct("_asked"), "iteration")["_asked"]
    context = F.min_by("_context", F.when(F.col("_context").isNotNull(), F.col("iteration")))
    return F.coalesce(asked, context, F.lit(NO_QUESTION))


def context_variable(iterations: DataFrame) -> DataFrame:
    """First non-empty text value of the variable ``context`` per run that has one."""
    found = iterations.select(
        "run_id", "iteration", context_in_blocks(F.col("code_blocks")).alias("_context")
    ).where(F.col("_context").isNotNull())
    return found.groupBy("run_id").agg(F.min_by("_context", "iteration").alias("context"))


def _last_answer() -> Column:
    # A pair counts even when its content is empty; a bare text only when it is not.
    counts = F.col("final_kind").isNotNull() | (F.col("final_answer") != "")
    return F.max_by("final_answer", F.when(counts, F.col("iteration")))


def final_answers(iterations: DataFrame) -> DataFrame:
    """Last given answer of each run that has one."""
    counts = F.col("final_kind").isNotNull() | (F.col("final_answer") != "")
    return (
        iterations.where(counts)
        .groupBy("run_id")
        .agg(F.max_by("final_answer", "iteration").alias("final_answer"))
    )


def run_summary(iterations: DataFrame) -> DataFrame:
    """One row per run, from one shuffle of narrow per-iteration figures."""
    seconds = F.coalesce("iteration_time", _block_sum(lambda b: b["result"]["execution_time"]))
    narrow = iterations.select(
        "run_id",
        "iteration",
        F.size("code_blocks").alias("_blocks"),
        _block_sum(lambda b: F.array_size(b["result"]["rlm_calls"]).cast("double"))
        .cast("long")
        .alias("_calls"),
        seconds.alias("_seconds"),
        F.exists(
            "code_blocks", lambda b: F.coalesce(b["result"]["stderr"] != "", F.lit(False))
        ).alias("_error"),
        question_in_prompt(F.col("prompt")).alias("_asked"),
        context_in_blocks(F.col("code_blocks"), below=500).alias("_context"),
        "final_kind",
        "final_answer",
    )
    return (
        narrow.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("n_iterations"),
            F.sum("_blocks").alias("n_blocks"),
            F.sum("_calls").alias("n_calls"),
            F.sum("_seconds").alias("seconds"),
            F.max("_error").alias("has_errors"),
            _question().alias("question"),
            _last_answer().alias("final_answer"),
        )
        .withColumn("completed", F.coalesce(F.col("final_answer") != "", F.lit(False)))
    )


def recent_runs(summaries: DataFrame, started: str, n: int = 10) -> DataFrame:
    """The latest ``n`` runs (a bounded top-k in every task, then one merge)."""
    return summaries.orderBy(F.col(started).desc(), F.col("run_id")).limit(n)


def number_iterations(
    df: DataFrame, run: str, order: list[str], slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """Add the 1-based iteration number of each row within its run."""
    return ordered_scan(df, [run], order, {"iteration": row_number()}, slice_rows)

