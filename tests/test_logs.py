"""Run logs with all the shapes that writers have given them."""

import json
import os
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.operators.trajectories import (
    context_question,
    context_variable,
    explode_code_blocks,
    explode_locals,
    explode_subcalls,
    final_answers,
    iteration_stats,
    run_summary,
)
from loomtext.operators.usage import merge_usage, usage_by_model, usage_of_subcalls
from loomtext.operators.variables import all_variables_as_of, redact_config, resolve_answers, user_variables, variables_as_of
from loomtext.sources.contexts import read_context_json, read_context_text
from loomtext.schema import BLOCK
from loomtext.sources.runlogs import (
    read_log_lines,
    read_trajectories,
    run_config,
    run_identity,
    upsert_runs,
    write_trajectories,
)
from loomtext.suite import QUERIES
from loomtext.suite.log_queries import write_logs

LONG = "Tell me which of the listed cities lies furthest to the north."


def call(**usage):
    return {"root_model": "m", "prompt": "p", "response": "r", "execution_time": 0.1, **usage}


def block(code="x = 1", stdout="", stderr="", variables=None, seconds=0.5, calls=()):
    result = {
        "stdout": stdout,
        "stderr": stderr,
        "locals": variables or {},
        "execution_time": seconds,
        "rlm_calls": list(calls),
    }
    return {"code": code, "result": result}


def turn(number, **fields):
    base = {
        "type": "iteration",
        "iteration": number,
        "timestamp": f"2024-01-01T00:00:0{number}.250000",
        "prompt": [{"role": "system", "content": "s"}, {"role": "user", "content": LONG}],
        "response": "thinking",
        "code_blocks": [],
        "final_answer": None,
        "iteration_time": 1.0,
    }
    return {**base, **fields}


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    runs = {
        "chat_2024-01-01_00-00-00_0000000a.jsonl": [
            {"type": "metadata", "timestamp": "2024-01-01T00:00:00", "root_model": "old"},
            {
                "type": "metadata",
                "timestamp": "2024-01-01T00:00:09",
                "root_model": "new",
                "max_depth": 1,
                "max_iterations": 30,
                "backend_kwargs": {"model_name": "n", "timeout": 5},
            },
            turn(
                1,
                iteration_time=None,
                code_blocks=[
                    block(
                        stderr="bad",
                        stdout="out",
                        variables={"z": 1, "_p": 2, "a": "t", "context": "C" * 600},
                        calls=[
                            call(
                                usage_summary={
                                    "model_usage_summaries": {
                                        "m": {
                                            "total_calls": 2,
                                            "total_input_tokens": 30,
                                            "total_output_tokens": 4,
                                        }
                                    }
                                }
                            ),
                            call(
                                usage_summary={
                                    "total_calls": 1,
                                    "total_input_tokens": 7,
                                    "total_output_tokens": 8,
                                }
                            ),
                        ],
                    ),
                    block(
                        calls=[
                            call(prompt_tokens=5, completion_tokens=6),
                            call(usage_summary={"model_usage_summaries": {}}),
                        ],
                        seconds=0.25,
                    ),
                ],
            ),
            turn(2, final_answer=["FINAL", "forty"], response="FINAL(forty)"),
        ],
        "other_2024-02-03_04-05-06_deadbeef.jsonl": [
            turn(1, final_answer="plain text", prompt="just text", extra=1),
            "{broken",
            "",
            "   ",
            "[1, 2]",
            turn(2, final_answer=None, response=7),
            {"response": "no type", "code_blocks": []},
        ],
        "notes.txt": ["ignored"],
    }
    for name, lines in runs.items():
        with open(os.path.join(folder, name), "w") as f:
            f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)
    return str(folder)


A, B = "chat_2024-01-01_00-00-00_0000000a.jsonl", "other_2024-02-03_04-05-06_deadbeef.jsonl"


def test_reading(spark, logs):
    configs, iterations, bad = read_trajectories(spark, logs)
    assert sorted(r["line"] for r in bad.collect()) == ["[1, 2]", "{broken"]
    rows = {(r["run_id"], r["iteration"]): r for r in iterations.collect()}
    assert set(rows) == {(A, 1), (A, 2), (B, 1), (B, 2), (B, None)}
    assert rows[A, 2]["final_answer"] == "forty" and rows[A, 2]["final_kind"] == "FINAL"
    assert rows[B, 1]["final_answer"] == "plain text" and rows[B, 1]["final_kind"] is None
    assert rows[A, 1]["final_answer"] is None and rows[B, 2]["response"] == "7"
    assert rows[B, 1]["prompt"][0]["content"] == "just text"
    assert str(rows[A, 2]["ts"]) == "2024-01-01 00:00:02.250000"
    config = {r["run_id"]: r for r in run_config(configs, iterations.select("run_id").distinct()).collect()}
    assert config[A]["root_model"] == "new" and config[A]["max_iterations"] == 30
    assert config[B]["root_model"] is None
    undated = configs.where("root_model = 'new'").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    assert run_config(undated, configs.select("run_id").distinct()).first()["root_model"] == "new"


def test_identity(spark, logs):
    files = read_log_lines(spark, logs).select(run_identity(F.col("file_path")).alias("r"))
    found = {r["r"]["run_id"]: r["r"] for r in files.distinct().collect()}
    assert set(found) == {A, B}
    assert (found[B]["name"], str(found[B]["started"]), found[B]["suffix"]) == (
        "other",
        "2024-02-03 04:05:06",
        "deadbeef",
    )


def test_flattening(spark, logs):
    _, iterations, _ = read_trajectories(spark, logs)
    calls = {
        (r["block_idx"], r["call_idx"]): r["usage"] for r in explode_subcalls(iterations).collect()
    }
    plain = {k: {m: tuple(u) for m, u in v.items()} if v else None for k, v in calls.items()}
    assert plain == {
        (0, 0): {"m": (2, 30, 4)},
        (0, 1): {"m": (1, 7, 8)},
        (1, 0): {"m": (None, 5, 6)},
        (1, 1): None,
    }
    used = usage_by_model(usage_of_subcalls(explode_subcalls(iterations)).where("model IS NOT NULL"))
    assert used.first()["total_input_tokens"] == 42
    blocks = explode_code_blocks(iterations.where(F.col("run_id") == A)).collect()
    assert [(r["iteration"], r["block_idx"], r["status"]) for r in blocks] == [
        (1, 0, "error"),
        (1, 1, "none"),
        (2, None, None),
    ]
    names = explode_locals(iterations).select("name", "value_text").collect()
    assert [tuple(r) for r in names][:3] == [("z", "1"), ("_p", "2"), ("a", "t")]


def test_rollups(spark, logs):
    _, iterations, _ = read_trajectories(spark, logs)
    stats = {
        (r["run_id"], r["iteration"]): r for r in iteration_stats(iterations).collect()
    }
    first = stats[A, 1]
    assert (first["n_blocks"], first["n_calls"], first["seconds"], first["status"]) == (2, 4, 0.75, "error")
    assert first["input_tokens"] == (len(LONG) + 1 + 2) // 4
    assert stats[A, 2]["status"] == "final" and stats[B, 2]["status"] == "plain"
    summary = {r["run_id"]: r for r in run_summary(iterations).collect()}
    a, b = summary[A], summary[B]
    assert (a["n_iterations"], a["n_blocks"], a["n_calls"], a["seconds"]) == (2, 2, 4, 1.75)
    assert a["has_errors"] and a["question"] == LONG and a["final_answer"] == "forty" and a["completed"]
    assert (b["n_iterations"], b["has_errors"], b["completed"]) == (3, False, True)
    assert b["question"] == "Context available in REPL environment"
    assert {r["run_id"]: r["final_answer"] for r in final_answers(iterations).collect()} == {
        A: "forty",
        B: "plain text",
    }
    assert [tuple(r) for r in context_variable(iterations).collect()] == [(A, "C" * 600)]


def messages(*pairs):
    return [{"role": role, "content": content} for role, content in pairs]


@pytest.mark.parametrize(
    "prompt, variables, question",
    [
        (messages(("user", 'The original query: "Why?" here')), {}, "Why?"),
        (messages(("user", "answer the prompt " + "x" * 60), ("user", "y" * 60)), {}, "y" * 60),
        (messages(("user", "z" * 300)), {}, "z" * 200 + "..."),
        (messages(("user", "x" * 50), ("user", "x" * 500)), {"context": "short"}, "short"),
        (messages(("system", "The Context Variable is: a book \nmore")), {"context": "c"}, "a book"),
        (messages(("user", "tiny")), {"context": "c" * 500}, "Context available in REPL environment"),
        (messages(("user", "tiny")), {"context": 5}, "Context available in REPL environment"),
        (messages(("assistant", 'original query: "no"'), ("user", 'original query: "yes"')), {}, "yes"),
    ],
)
def test_question(spark, tmp_path, prompt, variables, question):
    path = tmp_path / "q_2024-01-01_00-00-00_00000001.jsonl"
    path.write_text(json.dumps(turn(1, prompt=prompt, code_blocks=[block(variables=variables)])) + "\n")
    _, iterations, _ = read_trajectories(spark, str(tmp_path))
    assert context_question(iterations).first()["question"] == question


@pytest.mark.parametrize("packed", [False, True])
def test_written_logs_read_back(spark, logs, tmp_path, packed):
    configs, iterations, _ = read_trajectories(spark, logs)
    numbered = iterations.where("iteration IS NOT NULL")
    write_trajectories(configs, numbered, str(tmp_path), packed)
    back_configs, back, bad = read_trajectories(spark, str(tmp_path))
    assert bad.count() == 0

    def flat(df):
        return sorted(map(repr, df.select(F.to_json(F.struct(*df.columns))).collect()))

    assert flat(back) == flat(numbered)
    assert [r["root_model"] for r in back_configs.collect()] == ["old"]
    lines = [
        json.loads(line)
        for folder, _, names in sorted(os.walk(tmp_path))
        for name in sorted(names)
        if name.startswith("part-")
        for line in open(os.path.join(folder, name))
    ]
    own = [r for r in lines if r.get("run_id", A) == A and r["type"] == "metadata" or r.get("iteration")]
    assert own[0]["type"] == "metadata" and [r["iteration"] for r in own[1:3]] == [1, 2]
    # A second append adds new files and leaves the first ones alone.
    write_trajectories(configs.where("false"), numbered, str(tmp_path), packed)
    assert read_trajectories(spark, str(tmp_path))[1].count() == 2 * numbered.count()


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "run string, load long, v string")
    new = spark.createDataFrame([("a", 2, None), ("c", 2, "z")], "run string, load long, v string")
    found = {r["run"]: r["v"] for r in upsert_runs(old, new, ["run"], "load").collect()}
    assert found == {"a": None, "b": "y", "c": "z"}


def test_variables(spark):
    rows = spark.createDataFrame(
        [("_p", "1"), ("x", "42"), ("n", None), ("m", "<module 'os'>"), ("h", "<p>'</p>")],
        "name string, value string",
    )
    assert [r["name"] for r in user_variables(rows).collect()] == ["x", "h"]
    assigned = spark.createDataFrame(
        [(1, 1, "x", "42"), (1, 2, "y", "50"), (1, 3, "x", None), (1, 5, "x", "7")],
        "run_id long, at long, name string, value string",
    )
    moments = spark.range(0, 7).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("at"))
    for slice_rows in (3, 1000):
        held = variables_as_of(assigned, moments, "x", ["at"], slice_rows)
        values = [r["value"] for r in held.orderBy("at").collect()]
        assert values == [None, "42", "42", None, None, "7", "7"]


def test_answers(spark):
    held = spark.createDataFrame([(1, "result", "42")], "run_id long, name string, value string")
    given = spark.createDataFrame(
        [
            (1, "FINAL_VAR", ' "result" '),
            (1, "FINAL_VAR", "'result'\n"),
            (1, "FINAL_VAR", "missing"),
            (1, "FINAL", "result"),
        ],
        "run_id long, kind string, content string",
    )
    found = {r["content"]: (r["answer"], r["error"]) for r in resolve_answers(given, held).collect()}
    assert found == {
        ' "result" ': ("42", None),
        "'result'\n": ("42", None),
        "missing": (None, "Error: Variable 'missing' not found"),
        "result": ("result", None),
    }


def test_redaction_and_usage(spark):
    config = spark.range(1).select(
        F.create_map(
            *(F.lit(x) for x in ("API_KEY", "1", "key_for_api", "2", "token", "3", "Model", "4"))
        ).alias("c")
    )
    assert redact_config(config, "c").first()["c"] == {"token": "3", "Model": "4"}
    assert redact_config(config, "c", ("token",)).first()["c"] == {"Model": "4"}
    schema = "model string, total_calls long, total_input_tokens long, total_output_tokens long"
    first = spark.createDataFrame([("a", 10, 1000, 500), ("b", 5, 200, 100)], schema)
    second = spark.createDataFrame([("a", 2, 50, 25)], schema)
    summed = {r["model"]: tuple(r)[1:] for r in merge_usage(first, second).collect()}
    assert summed == {"a": (12, 1050, 525), "b": (5, 200, 100)}
    last = {r["model"]: tuple(r)[1:] for r in merge_usage(first, second, "last").collect()}
    assert last == {"a": (2, 50, 25), "b": (5, 200, 100)}


def test_context_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line 1\nline 2\n")
    (tmp_path / "b.json").write_text('{"z": "1", "a": "2"}')
    text = read_context_text(spark, str(tmp_path / "a.txt")).first()
    assert (text["text"], text["kind"]) == ("line 1\nline 2\n", "str")
    parts = read_context_json(spark, str(tmp_path / "b.json")).orderBy("part_idx").collect()
    assert [(r["part_key"], r["text"]) for r in parts] == [("z", "1"), ("a", "2")]


def test_log_lines_of_any_length(spark, tmp_path):
    """A variable beyond the JSON reader's default string limit is read whole."""
    long = "v" * 20_001_000
    folder = tmp_path / "logs"
    folder.mkdir()
    record = {
        "type": "iteration", "iteration": 1, "timestamp": "2024-01-01T00:00:00", "prompt": [], "response": "r",
        "code_blocks": [{"code": "c", "result": {"stdout": long, "stderr": "", "locals": {}, "execution_time": 0.1, "rlm_calls": []}}],
        "final_answer": None, "iteration_time": 1.0,
    }
    (folder / "a.jsonl").write_text(json.dumps(record))
    (folder / "a.jsonl.bak").write_text(json.dumps(record))
    _, iterations, bad = read_trajectories(spark, str(folder))
    assert bad.count() == 0
    found = iterations.select(F.length(F.col("code_blocks")[0]["result"]["stdout"]).alias("n")).collect()
    assert [r.n for r in found] == [len(long)]


@pytest.mark.parametrize("packed", [True, False])
def test_metadata_once_over_appends(spark, tmp_path, packed):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    configs = spark.createDataFrame(
        [("a.jsonl", None, "m"), ("b.jsonl", None, "m")], "run_id string, ts timestamp_ntz, root_model string"
    )
    iterations = spark.createDataFrame(
        [(r, i, None, None, f"{r} {i}", [], None, None, 1.0) for r in ("a.jsonl", "b.jsonl") for i in range(1, 5)],
        "run_id string, iteration long, ts timestamp_ntz, prompt array<struct<role:string,content:string>>, response string, "
        f"code_blocks array<{BLOCK}>, final_answer string, final_kind string, iteration_time double",
    )
    once = iterations.mapInPandas(counted, iterations.schema)
    write_trajectories(configs.where("run_id = 'a.jsonl'"), once.where("iteration < 3"), str(tmp_path), packed)
    assert calls.value == 8
    write_trajectories(configs, iterations.where("iteration >= 3"), str(tmp_path), packed)
    found, rows, bad = read_trajectories(spark, str(tmp_path))
    assert sorted(r["run_id"] for r in found.collect()) == ["a.jsonl", "b.jsonl"]
    assert rows.count() == 8 and bad.count() == 0


@pytest.mark.parametrize("ending", ["", "\n", "\r\n\n"])
def test_large_texts_in_parts(spark, tmp_path, ending):
    """Many tasks read one file; the parts join to it, whatever its lines are like."""
    texts = {
        "mixed": "\n".join("é😀x" * (i % 50) for i in range(3000)) + ending,
        "one line": "ab" * 20_000 + "ü" + ending,
        "blank lines": "\n" * 500 + ending,
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "empty.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        parts = read_context_text(spark, str(tmp_path), part_chars=700).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        own = sorted((r["part_idx"], r["text"]) for r in parts if name.replace(" ", "%20") in r["ctx_id"])
        assert "".join(t for _, t in own) == text
        assert [i for i, _ in own] == list(range(len(own))) and all(0 < len(t) < 1400 for _, t in own)
    assert not any("empty" in r["ctx_id"] for r in parts)


def test_all_variables_as_of_every_moment(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice("xyz"), i, rng.choice([None, str(i)])) for i in range(90)]
    assigned = spark.createDataFrame(rows, "run_id string, name string, at long, value string")
    moments = spark.createDataFrame([(r, i) for r in ("a", "b", None, "none") for i in range(0, 95, 2)], "run_id string, at long")
    expected = set()
    for run, at in [tuple(r) for r in moments.collect()]:
        for name in "xyz":
            own = [(i, v) for r, n, i, v in rows if r == run and n == name and i <= at]
            if own:
                expected.add((run, at, name, max(own)[1]))
    for slice_rows in (None, 7):
        found = all_variables_as_of(assigned, moments, ["at"], slice_rows).collect()
        assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_folders_of_runs_are_written_by_many_tasks(spark, tables):
    parts = {re.search(r"part-(\d+)", str(f))[1] for f in Path(write_logs(tables, packed=False)).rglob("part-*")}
    assert len(parts) >= spark.sparkContext.defaultParallelism


def test_logs_are_read_once_for_all_counts(tables):
    assert not [f for f in QUERIES["prj1_split_records"](tables).inputFiles() if ".jsonl" in f]
