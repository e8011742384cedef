"""Token usage roll-ups over a calls table (model, input_tokens, output_tokens, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.schema import USAGE

#: What a reduction, fold or loop reports beside its answers.
USAGE_COLUMNS = ["usage", "seconds", "n_errors"]


def _totals(calls: DataFrame) -> list:
    """Sums of a calls table; a row stands for ``total_calls`` calls where it has them, else for one."""
    number = F.coalesce("total_calls", F.lit(1)) if "total_calls" in calls.columns else F.lit(1)
    return [
        F.sum(number.cast("long")).alias("total_calls"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("total_tokens"),
    ]


def usage_by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(*_totals(calls))


def usage_totals(calls: DataFrame) -> DataFrame:
    """Per (run, model), per run and grand totals, told apart by ``level`` 0, 1 and 3.

    Calls are summed per (run, model) before the rollup, which would otherwise triple them.
    """
    summed = calls.groupBy("run_id", "model").agg(*_totals(calls))
    return summed.rollup("run_id", "model").agg(
        F.grouping_id().cast("long").alias("level"),
        *(
            F.sum(name).alias(name)
            for name in (
                "total_calls",
                "total_input_tokens",
                "total_output_tokens",
                "total_tokens",
            )
        ),
    )


def last_usage(calls: DataFrame, order: list[str]) -> DataFrame:
    """Usage of each model's most recent call by ``order``."""
    latest = F.max_by(F.struct("input_tokens", "output_tokens"), F.struct(*order))
    return (
        calls.groupBy("model")
        .agg(latest.alias("_last"))
        .select("model", "_last.input_tokens", "_last.output_tokens")
    )


def merge_usage(first: DataFrame, second: DataFrame, mode: str = "sum") -> DataFrame:
    """Combine two usage tables by model: add them up, or let the second replace the first."""
    fields = [c for c in first.columns if c != "model"]
    if mode == "sum":
        both = first.unionByName(second)
        return both.groupBy("model").agg(*(F.sum(c).alias(c) for c in fields))
    ranked = first.withColumn("_source", F.lit(0)).unionByName(
        second.withColumn("_source", F.lit(1))
    )
    latest = F.max_by(F.struct(*fields), "_source").alias("_latest")
    return ranked.groupBy("model").agg(latest).select("model", "_latest.*")


def usage_of_subcalls(subcalls: DataFrame) -> DataFrame:
    """Calls-table rows from exploded sub-calls, one per model named in a call's usage.

    A call without usage stands for one call of its ``root_model``.
    """
    named = [c for c in ("root_model",) if c in subcalls.columns]
    model = [F.coalesce("model", *named).alias("model")]
    return subcalls.select(
        "run_id",
        "iteration",
        "block_idx",
        "call_idx",
        *named,
        F.explode_outer("usage").alias("model", "_usage"),
    ).select(
        "run_id",
        "iteration",
        "block_idx",
        "call_idx",
        *model,
        F.col("_usage.total_calls").alias("total_calls"),
        F.col("_usage.total_input_tokens").alias("input_tokens"),
        F.col("_usage.total_output_tokens").alias("output_tokens"),
    )


def _usage_entry(calls, input_tokens, output_tokens) -> Column:
    entry = F.struct(
        calls.alias("total_calls"),
        input_tokens.alias("total_input_tokens"),
        output_tokens.alias("total_output_tokens"),
    )
    return entry.cast(USAGE)


def no_usage() -> list[Column]:
    """``USAGE_COLUMNS`` of what has called no model."""
    return [
        F.create_map().cast(f"map<string,{USAGE}>").alias("usage"),
        F.lit(None).cast("double").alias("seconds"),
        F.lit(0).cast("long").alias("n_errors"),
    ]


class UsageLedger:
    """What the calls of several rounds have cost, by key and model.

    Every round of written answers is summed by (key, model) before it is kept, so the ledger has a row per
    key, model and round, however many calls there were.
    """

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)
        self.rounds: DataFrame | None = None

    def add(self, asked: DataFrame) -> None:
        """Enter a round of ``ask`` (root_model, calls, input_tokens, output_tokens, seconds, error)."""
        model = F.coalesce("root_model", F.lit("unknown")).alias("_model")
        summed = asked.groupBy(*self.keys, model).agg(
            F.sum("calls").alias("_calls"),
            F.sum("input_tokens").alias("_input"),
            F.sum("output_tokens").alias("_output"),
            F.sum("seconds").alias("_seconds"),
            F.count("error").alias("_errors"),
        )
        self.rounds = summed if self.rounds is None else self.rounds.unionByName(summed)

    def add_maps(self, rows: DataFrame, seconds: str, failed: Column) -> None:
        """Enter calls that carry a usage map, as sub-calls in a log do. A call without one counts its time."""
        entries = rows.select(
            *self.keys, F.col(seconds).alias("_spent"), failed.alias("_failed"),
            F.posexplode_outer("usage").alias("_at", "_model", "_usage"),
        )
        first = F.coalesce("_at", F.lit(0)) == 0
        self.add(
            entries.select(
                *self.keys,
                F.col("_model").alias("root_model"),
                F.col("_usage.total_calls").alias("calls"),
                F.col("_usage.total_input_tokens").alias("input_tokens"),
                F.col("_usage.total_output_tokens").alias("output_tokens"),
                F.when(first, F.col("_spent")).alias("seconds"),
                F.when(first & F.col("_failed"), "failed").alias("error"),
            )
        )

    def by_key(self) -> DataFrame:
        """(keys, usage, seconds, n_errors): a map from model to calls and tokens, the seconds that all calls
        took together, and the calls that failed. Counts that no call reported are NULL."""
        per_model = self.rounds.groupBy(*self.keys, "_model").agg(
            *(F.sum(c).alias(c) for c in ("_calls", "_input", "_output", "_seconds", "_errors"))
        )
        entry = F.struct("_model", _usage_entry(F.col("_calls"), F.col("_input"), F.col("_output")))
        # A key's models are few; sorted, so that the map is the same on every run.
        return per_model.groupBy(*self.keys).agg(
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("usage"),
            F.sum("_seconds").alias("seconds"),
            F.sum("_errors").alias("n_errors"),
        )

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``USAGE_COLUMNS`` by their keys, which may be NULL."""
        spent = self.by_key()
        spent = spent.withColumnsRenamed({k: f"_spent_{k}" for k in self.keys})
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_spent_{k}")) for k in self.keys])
        return rows.join(spent, same, "left").select(*rows.columns, *USAGE_COLUMNS)


def explode_usage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls-table rows (keys, model, total_calls, input_tokens, output_tokens) from a usage map."""
    return rows.select(*keys, F.explode("usage").alias("model", "_usage")).select(
        *keys,
        "model",
        F.col("_usage.total_calls").alias("total_calls"),
        F.col("_usage.total_input_tokens").alias("input_tokens"),
        F.col("_usage.total_output_tokens").alias("output_tokens"),
    )
