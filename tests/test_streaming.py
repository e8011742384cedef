"""Streams give what the batch operators give, once their windows are closed."""

import json
import shutil
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomtext.models import RuleClient
from loomtext.scratch import scratch_path
from loomtext.sources.runlogs import read_trajectories
from loomtext.streaming.logs import metadata_once, stream_trajectories
from loomtext.streaming.progress import run_progress
from loomtext.streaming.requests import stream_ask, stream_match_timeouts
from loomtext.streaming.runner import drain, rows_dropped_late, start_to_table
from loomtext.streaming.usage import stream_usage
from loomtext.suite import QUERIES, Tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


class Feed:
    """A folder that a stream reads one file at a time, in the order of arrival."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, scratch_path(spark, "feed")

    def add(self, *rows):
        frame = self.spark.createDataFrame(list(rows), self.schema).coalesce(1)
        frame.write.mode("append").parquet(self.path)

    def stream(self):
        frame = self.spark.createDataFrame([], self.schema)
        reader = self.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(self.path)


def test_usage_windows_and_late_rows(spark):
    feed = Feed(spark, "ts timestamp, model string, input_tokens long, output_tokens long")
    feed.add((at(5), "a", 10, 1), (at(50), "b", 5, 2), (at(70), "a", 1, 1))
    # Spark judges lateness by the watermark of the batch before.
    feed.add((at(300), "a", 1, 1))
    feed.add((at(301), "a", 1, 1))
    feed.add((at(20), "a", 100, 100), (at(600), "a", 1, 1))
    windows, query = drain(stream_usage(feed.stream(), "1 hour", "30 minutes"))
    found = {
        (r["window_start"], r["model"]): (r["total_calls"], r["total_input_tokens"])
        for r in windows.collect()
    }
    assert found == {
        (at(0), "a"): (1, 10),
        (at(0), "b"): (1, 5),
        (at(60), "a"): (1, 1),
        (at(300), "a"): (2, 2),
    }
    assert rows_dropped_late(query) == 1


def test_timeouts(spark):
    requests = Feed(spark, "request_id long, request_ts timestamp")
    responses = Feed(spark, "request_id long, response_ts timestamp")
    requests.add((1, at(0)), (2, at(0)), (3, at(0)))
    responses.add((1, at(4)), (2, at(6)))
    requests.add((9, at(500)))
    responses.add((9, at(501)), (10, at(500)))
    # Until no earlier response can come, a request stays open.
    requests.add((99, at(900)))
    responses.add((99, at(900)))
    emitted, _ = drain(stream_match_timeouts(requests.stream(), responses.stream()))
    found = {r["request_id"]: (r["response_ts"], r["error"]) for r in emitted.collect() if r["request_id"] < 99}
    assert found == {
        1: (at(4), None),
        2: (None, "Request timed out"),
        3: (None, "Request timed out"),
        9: (at(501), None),
    }


def test_requests_are_answered_once(spark):
    feed = Feed(spark, "request_id long, prompt string")
    path, checkpoint = scratch_path(spark, "answers"), scratch_path(spark, "checkpoint")
    feed.add((1, "one"), (1, "one"), (2, "two"))
    stream_ask(feed.stream(), path, checkpoint).awaitTermination(120)
    feed.add((2, "two again"), (3, "three"))
    client = lambda: RuleClient(lambda prompt: "later")
    stream_ask(feed.stream(), path, checkpoint, client=client).awaitTermination(120)
    answers = spark.read.parquet(path)
    found = {r["request_id"]: r["answer"] for r in answers.collect()}
    assert answers.count() == 3
    assert found == {1: "Mock response to: one", 2: "Mock response to: two", 3: "later"}


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    package = "org.apache.spark.sql.execution.streaming.state"
    spark.conf.set(key, f"{package}.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_progress_over_batches(spark, rocksdb):
    feed = Feed(spark, "run_id string, has_error boolean, has_final boolean")
    feed.add(("1", True, False), ("1", False, False), ("2", False, True))
    feed.add(("1", True, False), ("3", False, False))
    emitted, _ = drain(run_progress(feed.stream(), max_iterations=3), 120)
    latest = emitted.groupBy("run_id").agg(
        F.max_by(F.struct("n_iterations", "n_errors", "answered", "ended"), "n_iterations").alias("s")
    )
    assert {r["run_id"]: tuple(r["s"]) for r in latest.collect()} == {
        "1": (3, 2, False, True),
        "2": (1, 0, True, True),
        "3": (1, 0, False, False),
    }


def test_counts_stop_at_the_end(spark, rocksdb):
    """A run of 40 turns, an answer in the midst, turns of a batch in any order: the same as in batch."""
    feed = Feed(spark, "run_id string, iteration long, has_error boolean, has_final boolean")
    turns = [("long", i, i % 3 == 0, False) for i in range(1, 41)]
    turns += [("early", i, True, i == 4) for i in range(1, 10)]
    for start in (1, 8, 21, 33):
        stop = {1: 8, 8: 21, 21: 33, 33: 99}[start]
        feed.add(*reversed([t for t in turns if start <= t[1] < stop]))
    emitted, _ = drain(run_progress(feed.stream()), 120)
    latest = emitted.groupBy("run_id").agg(
        F.max_by(F.struct("n_iterations", "n_errors", "answered", "ended"), "n_iterations").alias("s")
    )
    assert {r["run_id"]: tuple(r["s"]) for r in latest.collect()} == {
        "long": (30, 10, False, True),
        "early": (4, 4, True, True),
    }


def test_state_of_runs_is_freed(spark, rocksdb):
    feed = Feed(spark, "run_id string, ts timestamp, has_error boolean, has_final boolean")
    feed.add(*((f"r{i}", at(i), False, i % 2 == 0) for i in range(10)))
    feed.add(("r1", at(30), False, True), ("r2", at(31), True, False))
    feed.add(("late", at(300), False, False))
    feed.add(("last", at(301), False, False))
    emitted, query = drain(run_progress(feed.stream(), keep_seconds=3600, delay="10 minutes"), 120)
    held = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    freed = sum(m.get("numValueStateVars", 0) >= 0 for m in held)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert freed and max(rows) >= 10 and rows[-1] < max(rows)
    counts = {r["run_id"]: r["n"] for r in emitted.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    # r2 had ended when its late turn came, r1 had not.
    assert counts["r1"] == 2 and counts["r2"] == 1 and counts["late"] == 1


def test_earliest_of_several_responses(spark):
    """Responses out of order and over several batches; the rows equal those of the batch operator."""
    requests = Feed(spark, "request_id long, request_ts timestamp")
    responses = Feed(spark, "request_id long, response_ts timestamp")
    asked = [(i, at(i % 7)) for i in range(40)]
    given = [(i, at(i % 7 + late)) for i in range(40) if i % 4 for late in (4, 2, 9, 6, -1) if (i + late) % 3]
    for k in range(3):
        requests.add(*[r for i, r in enumerate(asked) if i % 3 == k])
        responses.add(*[r for i, r in enumerate(given) if i % 3 == 2 - k])
    requests.add((1000, at(900)))
    responses.add((1000, at(900)))
    emitted, _ = drain(stream_match_timeouts(requests.stream(), responses.stream(), delay="1 hour"), 200)
    found = sorted(map(tuple, emitted.where("request_id < 1000").collect()))
    expected = []
    for i, ts in asked:
        in_time = [r for j, r in given if j == i and ts <= r <= ts + timedelta(seconds=300)]
        expected.append((i, ts, min(in_time, default=None), None if in_time else "Request timed out"))
    assert found == sorted(expected)


def test_answers_are_not_read_again(spark):
    """A batch reads its own requests only, however many have been answered."""
    feed = Feed(spark, "request_id long, prompt string")
    path, checkpoint = scratch_path(spark, "answers"), scratch_path(spark, "checkpoint")
    for k in range(4):
        feed.add(*((i, f"prompt {i}") for i in range(10 * k, 10 * k + 15)))
    query = stream_ask(feed.stream(), path, checkpoint)
    query.awaitTermination(120)
    answers = spark.read.parquet(path)
    assert answers.count() == answers.select("request_id").distinct().count() == 45
    assert {p["numInputRows"] for p in query.recentProgress if p["numInputRows"]} == {15}


def test_first_metadata_counts(spark):
    feed = Feed(spark, "run_id string, ts timestamp, root_model string")
    feed.add(("a", at(0), "first"), ("b", at(1), "only"))
    feed.add(("a", at(2), "second"))
    emitted, _ = drain(metadata_once(feed.stream(), "1 hour"))
    assert {r["run_id"]: r["root_model"] for r in emitted.collect()} == {"a": "first", "b": "only"}


def test_new_logs_are_picked_up(spark, tmp_path):
    logs, table, checkpoint = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "cp")
    logs.mkdir()

    def log(name, turns):
        lines = [json.dumps({"type": "metadata", "root_model": "m"})]
        for i in range(1, turns + 1):
            lines.append(json.dumps({"type": "iteration", "iteration": i, "response": f"r{i}"}))
        lines.append("{broken")
        (logs / f"{name}_2024-01-01_00-00-00_0000000{turns}.jsonl").write_text("\n".join(lines))

    log("a", 2)
    _, iterations = stream_trajectories(spark, str(logs))
    kept = iterations.select("run_id", "iteration", "response")
    start_to_table(kept, table, checkpoint).awaitTermination(120)
    assert spark.read.parquet(table).count() == 2
    log("b", 3)
    start_to_table(kept, table, checkpoint).awaitTermination(120)
    _, batch, _ = read_trajectories(spark, str(logs))
    expected = sorted(map(repr, batch.select("run_id", "iteration", "response").collect()))
    assert sorted(map(repr, spark.read.parquet(table).collect())) == expected


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    rows = [(n, f"text {n}") for n in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    documents.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    documents.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (part,) = (tmp_path / "parts").glob("part-*.parquet")
    (tmp_path / "one").mkdir()
    shutil.copy(part, tmp_path / "one" / "documents.parquet")
    for folder in ("many", "one"):
        emitted, _ = drain(Tables(spark, f"{tmp_path}/{folder}").stream("documents"))
        assert sorted(map(tuple, emitted.collect())) == rows
    answers = QUERIES["str3_stream_ask"](Tables(spark, f"{tmp_path}/many"))
    assert sorted(row.request_id for row in answers.collect()) == list(range(40))
