"""Variables of a run: which ones to show, their value over time, and answers that name one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.messages import is_opaque_text
from loomtext.functions.text import strip_blanks, strip_characters
from loomtext.operators.ordering import SLICE_ROWS, last_seen, ordered_scan


def user_variables(variables: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Drop private names, NULL values, and values logged as module or function text."""
    kept = ~F.startswith(name, F.lit("_")) & F.col(value).isNotNull()
    return variables.where(kept & ~is_opaque_text(F.col(value)))


def latest_variables(variables: DataFrame, order: list[str]) -> DataFrame:
    """Value of each (run, name) after its last assignment."""
    return variables.groupBy("run_id", "name").agg(
        F.max_by("value", F.struct(*order)).alias("value")
    )


def variables_as_of(
    variables: DataFrame,
    moments: DataFrame,
    name: str,
    order: list[str],
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """For every row of ``moments`` (run_id and the order columns), the value ``name`` holds then.

    An assignment at the same moment counts. Both sides go through one ordered scan, so the cost is
    linear however often a variable changes.
    """
    assigned = variables.where(F.col("name") == name).select(
        "run_id", *order, F.struct("value").alias("_held"), F.lit(0).alias("_kind")
    )
    asked = moments.select(
        "run_id",
        *order,
        F.lit(None).cast(assigned.schema["_held"].dataType).alias("_held"),
        F.lit(1).alias("_kind"),
    )
    scanned = ordered_scan(
        assigned.unionByName(asked),
        ["run_id"],
        [*order, "_kind"],
        {"_now": last_seen("_held")},
        slice_rows,
    )
    return scanned.where(F.col("_kind") == 1).select(
        "run_id", *order, F.lit(name).alias("name"), F.col("_now.value").alias("value")
    )


def all_variables_as_of(
    variables: DataFrame,
    moments: DataFrame,
    order: list[str],
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """For every row of ``moments`` (run_id and the order columns), what every name of its run that has been
    assigned by then holds: (run_id, order, name, value).

    One scan keyed by (run, name). A moment meets only the names that are alive in its run, so no more rows
    are made than come out.
    """
    born = variables.groupBy("run_id", "name").agg(F.min(F.struct(*order)).alias("_born")).select(
        F.col("run_id").alias("_run"), "name", "_born"
    )
    alive = F.col("run_id").eqNullSafe(F.col("_run")) & (F.struct(*order) >= F.col("_born"))
    assigned = variables.select(
        "run_id", "name", *order, F.struct("value").alias("_held"), F.lit(0).alias("_kind")
    )
    asked = moments.select("run_id", *order).join(born, alive).select(
        "run_id", "name", *order,
        F.lit(None).cast(assigned.schema["_held"].dataType).alias("_held"),
        F.lit(1).alias("_kind"),
    )
    scanned = ordered_scan(
        assigned.unionByName(asked), ["run_id", "name"], [*order, "_kind"], {"_now": last_seen("_held")}, slice_rows
    )
    return scanned.where(F.col("_kind") == 1).select(
        "run_id", *order, "name", F.col("_now.value").alias("value")
    )


def clean_name(name):
    """A variable name as written in an answer, without blanks and quotes around it."""
    unquoted = strip_characters(strip_characters(strip_blanks(name), '"'), "'")
    return strip_characters(strip_characters(unquoted, "\n"), "\r")


def resolve_answers(answers: DataFrame, variables: DataFrame) -> DataFrame:
    """Look up answers of kind FINAL_VAR; ``variables`` has one row per (run_id, name).

    A miss has a NULL answer and an error text.
    """
    wanted = answers.withColumn(
        "name", F.when(F.col("kind") == "FINAL_VAR", clean_name(F.col("content")))
    )
    held = variables.select("run_id", "name", "value", F.lit(True).alias("_held"))
    found = wanted.join(held, ["run_id", "name"], "left")
    is_variable = F.col("kind") == "FINAL_VAR"
    answer = F.when(is_variable, F.col("value")).otherwise(F.col("content"))
    missed = is_variable & F.col("_held").isNull()
    error = F.when(
        missed, F.concat(F.lit("Error: Variable '"), F.col("name"), F.lit("' not found"))
    )
    return found.withColumn("answer", answer).withColumn("error", error).drop("value", "_held")


def serialise_values(df: DataFrame, variables: str) -> DataFrame:
    """Replace a MAP or STRUCT of values by its JSON text, NULL entries kept."""
    return df.withColumn(variables, F.to_json(variables, {"ignoreNullFields": "false"}))


def redact_config(df: DataFrame, config: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Drop map entries whose key holds both ``api`` and ``key`` in any case, or a word of ``extra``."""

    def is_public(key, value):
        lowered = F.lower(key)
        secret = F.contains(lowered, F.lit("api")) & F.contains(lowered, F.lit("key"))
        for word in extra:
            secret = secret | F.contains(lowered, F.lit(word))
        return ~secret

    return df.withColumn(config, F.map_filter(config, is_public))
