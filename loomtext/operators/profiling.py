"""Profiles of contexts: part lengths, totals, kind, and the line shown to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.messages import render_prompt

# The sentence that describes a context, and how many part lengths it names.
PROFILE_LINE = (
    "Your context is a {context_type} with {context_total_length} total characters, "
    "and is broken up into chunks of char lengths: {lengths}."
)
SHOWN_PARTS = 100


def part_lengths(parts: DataFrame) -> DataFrame:
    """(ctx_id, part_idx, length) rows. Reads lengths only, so text never meets a shuffle."""
    return parts.select("ctx_id", "part_idx", F.length("text").cast("long").alias("length"))


def context_profile(parts: DataFrame) -> DataFrame:
    """Per context: kind, number of parts, total length. Lengths themselves are ``part_lengths`` rows,
    since a context may have more parts than one row can hold."""
    # A context has one kind. As a key it costs nothing, while a text aggregate would make Spark sort.
    lengths = parts.select(
        "ctx_id", F.col("kind").alias("context_type"), F.length("text").cast("long").alias("_length")
    )
    return lengths.groupBy("ctx_id", "context_type").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("_length").alias("context_total_length")
    )


def truncation_report(df: DataFrame, text: str, limit: int) -> DataFrame:
    """How many texts a cut at ``limit`` characters would shorten, and what it would lose."""
    length = F.length(text).cast("long")
    return df.select(length.alias("_length")).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.col("_length") > limit).alias("n_truncated"),
        F.coalesce(F.sum(F.greatest(F.col("_length") - limit, F.lit(0))), F.lit(0)).alias("chars_lost"),
    )


def first_parts(parts: DataFrame, n: int = SHOWN_PARTS, salts: int = 64) -> DataFrame:
    """The first ``n`` parts of every context, by part_idx.

    Ranked within (context, salt) first, so that a context with a third of all parts is cut down in
    many tasks before its survivors, at most ``n * salts``, meet in one.
    """
    salted = part_lengths(parts).withColumn("_salt", F.pmod(F.xxhash64("part_idx"), F.lit(salts)))
    local = Window.partitionBy("ctx_id", "_salt").orderBy("part_idx")
    whole = Window.partitionBy("ctx_id").orderBy("part_idx")
    return (
        salted.withColumn("_rank", F.row_number().over(local))
        .where(F.col("_rank") <= n)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= n)
        .drop("_salt", "_rank")
    )


def profile_line(parts: DataFrame) -> DataFrame:
    """The sentence that tells a model how its context is laid out; lengths past 100 are counted."""
    shown = (
        first_parts(parts)
        .groupBy("ctx_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "length"))).alias("_shown"))
        .withColumnRenamed("ctx_id", "_ctx_id")
    )
    # NULL is a context like any other.
    joined = context_profile(parts).join(shown, F.col("ctx_id").eqNullSafe(F.col("_ctx_id")))
    lengths = F.concat(F.lit("["), F.array_join(F.col("_shown.length"), ", "), F.lit("]"))
    others = F.when(
        F.col("n_parts") > SHOWN_PARTS,
        F.concat(
            F.lit("... ["), (F.col("n_parts") - SHOWN_PARTS).cast("string"), F.lit(" others]")
        ),
    ).otherwise("")
    line = render_prompt(PROFILE_LINE, lengths=F.concat(lengths, others))
    return joined.select("ctx_id", "n_parts", "context_total_length", line.alias("line"))
