"""Message history of runs, each message stored once.

A prompt is every earlier message, so building all prompts of a run repeats its text once per turn.
These operators keep messages as rows and assemble a prompt only for the turn that is due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.messages import iteration_messages
from loomtext.operators.ordering import SLICE_ROWS, ordered_scan, running_sum

# Longest prompt that is put together in one row.
PROMPT_CHARS = 50_000_000

HISTORY_COLUMNS = ["run_id", "iteration", "seq", "role", "content"]


def history_of(iterations: DataFrame, limit: int = 20_000) -> DataFrame:
    """Messages each iteration adds: (run_id, iteration, seq, role, content), outputs cut to ``limit``."""
    added = iteration_messages(F.col("response"), F.col("code_blocks"), limit)
    return iterations.select(
        "run_id", "iteration", F.posexplode(added).alias("seq", "message")
    ).select(
        "run_id",
        F.col("iteration").cast("long").alias("iteration"),
        F.col("seq").cast("long").alias("seq"),
        F.col("message.role").alias("role"),
        F.col("message.content").alias("content"),
    )


def append_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with a round's messages added; equal messages stay apart."""
    return history.unionByName(new)


def prompt_growth(history: DataFrame, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Per iteration, messages and characters of all earlier iterations, without building any text."""
    added = history.groupBy("run_id", "iteration").agg(
        F.count(F.lit(1)).alias("_messages"),
        F.sum(F.length("content").cast("long")).alias("_chars"),
    )
    scanned = ordered_scan(
        added,
        ["run_id"],
        ["iteration"],
        {"_m": running_sum("_messages"), "_c": running_sum("_chars")},
        slice_rows,
    )
    return scanned.select(
        "run_id",
        "iteration",
        (F.col("_m") - F.col("_messages")).alias("messages_before"),
        (F.col("_c") - F.col("_chars")).alias("chars_before"),
    )


def assemble_prompts(
    history: DataFrame, due: DataFrame, limit_chars: int | None = PROMPT_CHARS
) -> DataFrame:
    """Add ``prompt`` to ``due`` (one row per run: run_id, iteration, ...): all earlier messages in order.

    A prompt is one value for one model call. Where it would pass ``limit_chars`` it is NULL and
    ``prompt_error`` says so, so no task collects a history of any length; ``prompt_growth`` still covers
    such runs. None skips the check, for callers whose rounds and outputs bound the history.
    """
    earlier = history.join(due.select("run_id", F.col("iteration").alias("_due")), "run_id").where(
        F.col("iteration") < F.col("_due")
    )
    error = F.lit(None).cast("string")
    if limit_chars is not None:
        too_long = (
            earlier.groupBy("run_id")
            .agg(F.sum(F.length("content").cast("long")).alias("_chars"))
            .where(F.col("_chars") > limit_chars)
        )
        earlier = earlier.join(too_long, "run_id", "left_anti")
        due = due.join(too_long, "run_id", "left")
        error = F.when(
            F.col("_chars").isNotNull(),
            F.concat(F.lit("Prompt too long: "), F.col("_chars").cast("string"), F.lit(" characters")),
        )
    messages = F.array_sort(F.collect_list(F.struct("iteration", "seq", "role", "content")))
    prompts = (
        earlier.groupBy("run_id")
        .agg(messages.alias("_m"))
        .select(
            "run_id",
            F.transform(
                "_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
            ).alias("prompt"),
        )
    )
    none = F.array().cast("array<struct<role:string,content:string>>")
    return (
        due.join(prompts, "run_id", "left")
        .withColumn("prompt_error", error)
        .withColumn(
            "prompt", F.when(F.col("prompt_error").isNull(), F.coalesce("prompt", none))
        )
        .drop("_chars")
    )
