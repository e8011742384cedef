"""Batched model calls over a DataFrame, with errors and usage as columns."""

from __future__ import annotations

import asyncio
import itertools
import queue
import threading
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.models import Client, ClientFactory, Completion, EchoClient
from loomtext.scratch import path_exists, scratch_path
from loomtext.session import ship_package

ANSWER_FIELDS = [
    T.StructField("root_model", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("calls", T.LongType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("seconds", T.DoubleType()),
]

ANSWER_TYPES = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.float64()]

# Fixed value: the error of a call that gave neither a response nor an error.
NO_RESULT = "No chat completion or error provided."


#: Seconds that a call may take. Fixed value.
TIMEOUT_SECONDS = 300.0
#: Bytes of an Arrow batch that a task holds as Python objects, prompts and answers each, twice at most.
SLICE_BYTES = 4_000_000


@dataclass(frozen=True)
class Limits:
    """What a task allows its calls: ``timeout`` seconds for an attempt, ``retries`` further attempts after a
    failed one, each after twice the pause of the one before (from ``backoff`` seconds, by half more or less
    as the prompt's hash says), and ``per_second`` attempts begun by the task."""

    timeout: float | None = TIMEOUT_SECONDS
    retries: int = 0
    backoff: float = 1.0
    per_second: float | None = None

    def pause(self, prompt, attempt: int) -> float:
        """Seconds before attempt number ``attempt`` (from 1), the same on every run of a task."""
        drawn = zlib.crc32(f"{attempt}:{prompt}".encode(errors="replace")) / 2**32
        return self.backoff * 2 ** (attempt - 1) * (0.5 + drawn)


class _Pace:
    """Deals out start times at a rate."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> float:
        """Seconds until the start that is taken by this."""
        if not self.gap:
            return 0.0
        with self.lock:
            now = time.monotonic()
            start = max(self.next, now)
            self.next = start + self.gap
            return start - now


def _answered(model: str | None, done: Completion, started: float) -> tuple:
    error = NO_RESULT if done.response is None else None
    usage = (done.calls, done.input_tokens, done.output_tokens)
    return (model, done.response, error, *usage, time.perf_counter() - started)


def _failed(model: str | None, failure: Exception | str, started: float) -> tuple:
    text = str(failure) or type(failure).__name__
    return (model, None, text, None, None, None, time.perf_counter() - started)


def _late(limits: Limits) -> str:
    return f"No answer within {limits.timeout:g} seconds."


class _Threads:
    """Runs the calls of a client without a coroutine in ``concurrency`` threads.

    A thread cannot be stopped, so one whose call is late is left behind, its call fails, and another
    thread takes its place. Threads are daemons, so none keeps the worker from ending.
    """

    def __init__(self, service: Client, concurrency: int, limits: Limits):
        self.service, self.limits, self.pace = service, limits, _Pace(limits.per_second)
        self.todo: queue.SimpleQueue = queue.SimpleQueue()
        self.done: queue.SimpleQueue = queue.SimpleQueue()
        self.tick = None if limits.timeout is None else max(0.01, min(1.0, limits.timeout / 10))
        self.running: dict[int, tuple] = {}
        self.names = itertools.count()
        for _ in range(concurrency):
            self._start()

    def _start(self) -> None:
        threading.Thread(target=self._work, args=(next(self.names),), daemon=True).start()

    def _work(self, name: int) -> None:
        while (item := self.todo.get()) is not None:
            _, (prompt, model), attempt = item
            if attempt:
                time.sleep(self.limits.pause(prompt, attempt))
            if wait := self.pace.wait():
                time.sleep(wait)
            started = time.perf_counter()
            self.running[name] = (time.monotonic(), item)
            try:
                row = _answered(model, self.service.complete(prompt, model), started)
            except Exception as failure:
                row = _failed(model, failure, started)
            if self.running.pop(name, None) is None:
                return  # Given up meanwhile.
            self._finish(item, row)

    def _finish(self, item: tuple, row: tuple) -> None:
        place, call, attempt = item
        if row[2] is not None and attempt < self.limits.retries:
            self.todo.put((place, call, attempt + 1))
        else:
            self.done.put((place, row))

    def _give_up_late(self) -> None:
        for name, (since, item) in list(self.running.items()):
            if time.monotonic() - since > self.limits.timeout and self.running.pop(name, None):
                self._start()
                started = time.perf_counter() - (time.monotonic() - since)
                self._finish(item, _failed(item[1][1], _late(self.limits), started))

    def submit(self, place: int, call: tuple) -> None:
        self.todo.put((place, call, 0))

    def result(self) -> tuple[int, tuple]:
        """Place and answer row of some call that has ended."""
        while True:
            try:
                return self.done.get(timeout=self.tick)
            except queue.Empty:
                self._give_up_late()

    def close(self) -> None:
        for _ in range(next(self.names)):
            self.todo.put(None)


class _Coroutines:
    """Awaits the calls of a client with a coroutine on one event loop, ``concurrency`` at a time."""

    def __init__(self, service: Client, concurrency: int, limits: Limits):
        self.service, self.limits, self.pace = service, limits, _Pace(limits.per_second)
        self.runner, self.gate = asyncio.Runner(), asyncio.Semaphore(concurrency)
        self.open: set[asyncio.Task] = set()
        self.ended: list[tuple[int, tuple]] = []

    def submit(self, place: int, call: tuple) -> None:
        self.open.add(self.runner.get_loop().create_task(self._answer(place, call)))

    def result(self) -> tuple[int, tuple]:
        """Place and answer row of some call that has ended."""
        if not self.ended:
            self.runner.run(self._some())
        return self.ended.pop()

    async def _some(self) -> None:
        ended, self.open = await asyncio.wait(self.open, return_when=asyncio.FIRST_COMPLETED)
        self.ended.extend(task.result() for task in ended)

    async def _answer(self, place: int, call: tuple) -> tuple[int, tuple]:
        async with self.gate:
            for attempt in range(self.limits.retries + 1):
                if attempt:
                    await asyncio.sleep(self.limits.pause(call[0], attempt))
                if wait := self.pace.wait():
                    await asyncio.sleep(wait)
                row = await self._attempt(*call)
                if row[2] is None:
                    break
        return place, row

    async def _attempt(self, prompt, model: str | None) -> tuple:
        started, limit = time.perf_counter(), self.limits.timeout
        try:
            async with asyncio.timeout(limit) as deadline:
                return _answered(model, await self.service.acomplete(prompt, model), started)
        except Exception as failure:
            # A client may raise TimeoutError of its own accord.
            late = isinstance(failure, TimeoutError) and deadline.expired()
            return _failed(model, _late(self.limits) if late else failure, started)

    def close(self) -> None:
        self.runner.close()


@contextmanager
def answering(service: Client, concurrency: int, limits: Limits):
    """Calls with ``concurrency`` of them in flight: ``submit(place, (prompt, model))`` and ``result()``."""
    kind = _Coroutines if hasattr(service, "acomplete") else _Threads
    calls = kind(service, concurrency, limits)
    try:
        yield calls
    finally:
        calls.close()


def _answer_slices(calls, batch: pa.RecordBatch, width: int, least: int) -> Iterator[tuple[int, list[tuple]]]:
    """(first row, answer rows) of successive slices of a batch, in its order.

    A slice has about ``SLICE_BYTES``, and ``least`` rows or more. Prompts become Python objects and are handed over
    up to a slice ahead, so as many calls are in flight between slices as within one.
    """
    n, sent, ended = batch.num_rows, 0, {}
    step = max(least, n * SLICE_BYTES // max(batch.nbytes, 1))
    for begin in range(0, n, step):
        end = min(begin + step, n)
        missing = sum(place not in ended for place in range(begin, end))
        while missing:
            upto = min(end + step, n)
            room = step - (sent - begin - len(ended))
            for place in range(sent, min(sent + room, upto)):
                calls.submit(place, (batch.column(width)[place].as_py(), batch.column(width + 1)[place].as_py()))
                sent += 1
            place, row = calls.result()
            ended[place] = row
            missing -= place < end
        yield begin, [ended.pop(place) for place in range(begin, end)]


def ask(
    df: DataFrame,
    client: ClientFactory = EchoClient,
    prompt: str = "prompt",
    model: str | Column | None = None,
    keep: Sequence[str] | None = None,
    concurrency: int = 8,
    partitions: int | None = None,
    setup: Callable[[], None] | None = None,
    where: Column | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """One model call per row. Keeps ``keep`` (default: every column but the prompt).

    A failing call becomes an ``error`` text and leaves its neighbours alone, and so does one that takes
    longer than ``limits`` allow, after the retries they allow; tokens and time are the last attempt's.
    ``concurrency`` calls are in flight per task. Row order carries no meaning; carry a position column instead. Filters on input
    columns belong in ``where`` or before the call, as Spark cannot move one through Python.
    """
    ship_package(df.sparkSession)
    if where is not None:
        df = df.where(where)
    kept = [c for c in df.columns if c != prompt] if keep is None else list(keep)
    chosen = F.lit(model) if model is None or isinstance(model, str) else model
    source = df.select(*kept, F.col(prompt).alias("_prompt"), chosen.cast("string").alias("_model"))
    if partitions:
        # By the ids, which spread evenly; without a key Spark would sort the rows first.
        source = source.repartition(partitions, *([F.xxhash64(*kept)] if kept else []))
    schema = T.StructType([source.schema[c] for c in kept] + ANSWER_FIELDS)
    width = len(kept)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup is not None:
            setup()
        service = client()
        with answering(service, concurrency, limits) as calls:
            for batch in batches:
                for begin, rows in _answer_slices(calls, batch, width, concurrency):
                    arrays = [
                        pa.array(values, type=kind) for values, kind in zip(zip(*rows), ANSWER_TYPES)
                    ]
                    kept_columns = batch.slice(begin, len(rows)).columns[:width]
                    yield pa.RecordBatch.from_arrays(kept_columns + arrays, names=schema.names)

    return source.mapInArrow(answer, schema)


def ask_stored(
    df: DataFrame,
    request_id: str,
    store: str | None = None,
    rounds: int = 1,
    **options,
) -> DataFrame:
    """Ask each ``request_id`` once, also a repeated one, and keep the answers in a Parquet table.

    A second run over the same store asks only what is missing or has failed, so a failed job resumes. With
    ``rounds`` above 1 the requests are asked and committed in that many jobs, which bounds what a
    failed job loses. The store keeps the failures of all runs; those of the last are given, the others have
    been asked again since.
    """
    spark = df.sparkSession
    resumed = store is not None and path_exists(spark, store)
    store = store or scratch_path(spark, "answers")
    once = df.dropDuplicates([request_id])
    run, answered = 0, None
    if resumed:
        answered = spark.read.parquet(store)
        run = answered.agg(F.max("_run")).first()[0] + 1
    for number in range(rounds):
        due = once
        if rounds > 1:
            due = once.where(F.pmod(F.xxhash64(request_id), F.lit(rounds)) == number)
        if answered is not None:
            due = due.join(answered.where("NOT _failed").select(request_id), request_id, "left_anti")
        answers = ask(due, **options)
        marked = answers.withColumn("_run", F.lit(run)).withColumn("_failed", F.col("error").isNotNull())
        marked.write.partitionBy("_run", "_failed").mode("append").parquet(store)
    kept = spark.read.schema(marked.schema).parquet(store)
    return kept.where(~F.col("_failed") | (F.col("_run") == run)).drop("_run", "_failed")


def errors_as_values(
    df: DataFrame, batch: str | None = None, batch_atomic: bool = False, prefix: str = "Error: "
) -> DataFrame:
    """Add ``answer``: the response, or the error as text.

    An error wins over a response, and a row with neither gets a fixed text. ``batch_atomic`` fails
    every row of a batch that holds a failure, with the batch's alphabetically first error.
    """
    error = F.coalesce(F.col("error"), F.when(F.col("response").isNull(), NO_RESULT))
    marked = df.withColumn("error", error)
    if batch_atomic:
        failed = (
            marked.where(F.col("error").isNotNull())
            .groupBy(batch)
            .agg(F.min("error").alias("_batch_error"))
        )
        marked = marked.join(failed, batch, "left").withColumn(
            "error", F.coalesce("error", "_batch_error")
        )
        marked = marked.drop("_batch_error")
    answer = F.when(
        F.col("error").isNotNull(), F.concat(F.lit(prefix), F.col("error"))
    ).otherwise(F.col("response"))
    return marked.withColumn("answer", answer)


def completion_records(df: DataFrame, batch: str, seconds: str = "seconds") -> DataFrame:
    """Replace each call's time by an even share of its batch's time."""
    shares = df.groupBy(F.col(batch).alias("_batch")).agg(
        (F.sum(seconds) / F.count(F.lit(1))).alias("execution_time"),
        F.count(F.lit(1)).alias("batch_calls"),
    )
    same = F.col(batch).eqNullSafe(F.col("_batch"))
    return df.drop(seconds).join(shares, same).drop("_batch")


def completion_struct(prompt: Column) -> Column:
    """Pack answer columns into one STRUCT<root_model, prompt, response, usage, execution_time>."""
    usage = F.struct(
        F.col("calls").alias("total_calls"),
        F.col("input_tokens").alias("total_input_tokens"),
        F.col("output_tokens").alias("total_output_tokens"),
    )
    return F.struct(
        F.col("root_model"),
        prompt.alias("prompt"),
        F.col("response"),
        F.create_map(F.coalesce(F.col("root_model"), F.lit("unknown")), usage).alias("usage"),
        F.col("seconds").alias("execution_time"),
    )
