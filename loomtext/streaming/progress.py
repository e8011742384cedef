"""State of running questions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Spark starts the processor once on the driver too, in a worker that shipped packages do not reach.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS = "n_iterations long, n_errors long, answered boolean, ended boolean"


class RunProgress(StatefulProcessor):
    """Counts per run; a run ends on an answer, at its last turn, or after lying idle. What comes after the
    end is not counted: the state of an ended run stays as a mark of it until it is forgotten, which an
    event-time timer does."""

    def __init__(self, max_iterations: int, idle_seconds: int, keep_seconds: int):
        self.max_iterations = max_iterations
        self.idle_seconds = idle_seconds
        self.keep_seconds = keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS)

    def _row(self, key, iterations, errors, answered, ended) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "run_id": [key[0]],
                "n_iterations": [iterations],
                "n_errors": [errors],
                "answered": [answered],
                "ended": [ended],
            }
        )

    def _set_timer(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = self.counts.get() if self.counts.exists() else (0, 0, False, False)
        iterations, errors, answered, ended = held
        if ended:
            return
        turns = pd.concat(list(rows))
        if "iteration" in turns.columns:
            turns = turns.sort_values("iteration", kind="stable")
        for has_error, has_final in zip(turns["has_error"], turns["has_final"], strict=True):
            iterations += 1
            errors += bool(has_error)
            answered = bool(has_final)
            ended = answered or iterations >= self.max_iterations
            if ended:
                break
        self.counts.update((iterations, errors, answered, ended))
        if self.keep_seconds:
            latest = int(turns["ts"].max().timestamp() * 1000)
            self._set_timer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.keep_seconds * 1000)
        elif self.idle_seconds and not ended:
            self._set_timer(timerValues.getCurrentProcessingTimeInMs() + self.idle_seconds * 1000)
        yield self._row(key, iterations, errors, answered, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        iterations, errors, answered, ended = self.counts.get()
        if self.keep_seconds:
            self.counts.clear()
        elif not ended:
            self.counts.update((iterations, errors, answered, True))
            yield self._row(key, iterations, errors, answered, True)

    def close(self) -> None:
        pass


def run_progress(
    iterations: DataFrame,
    max_iterations: int = 30,
    idle_seconds: int = 0,
    keep_seconds: int = 0,
    delay: str = "1 hour",
) -> DataFrame:
    """A row with the state of every open run touched by a batch; ``iterations`` has run_id, has_error,
    has_final, and ``iteration`` if the turns of a batch are to be taken in order. Needs the RocksDB state
    store provider.

    Counts stop at a run's end. With ``keep_seconds``, for which ``iterations`` has a TIMESTAMP ``ts``, a run is
    forgotten, ended or not, once the watermark (``delay`` behind the latest turn) is so far past its last turn,
    so state does not grow with all runs ever seen. With ``idle_seconds`` a run ends after that long without
    an iteration, by the clock. Such timers keep the query running, so they suit a continuous trigger and not
    one that stops when the input is used up. The two cannot be had together.
    """
    if idle_seconds and keep_seconds:
        raise ValueError("idle_seconds goes by the clock, keep_seconds by event time: give one of them.")
    mode = "ProcessingTime" if idle_seconds else "None"
    if keep_seconds:
        iterations, mode = iterations.withWatermark("ts", delay), "EventTime"
    run_type = iterations.schema["run_id"].dataType.simpleString()
    return iterations.groupBy("run_id").transformWithStateInPandas(
        RunProgress(max_iterations, idle_seconds, keep_seconds),
        f"run_id {run_type}, {COUNTS}",
        "Append",
        mode,
    )
