"""Model calls, reductions and question loops."""

import asyncio
import sys
import time
import tracemalloc
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomtext.functions.messages import CLOSING_PROMPT, render_prompt
from loomtext.models import Completion, EchoClient, FailingClient, RuleClient, prompt_text
from loomtext.operators.asking import NO_RESULT, Limits, ask, ask_stored, errors_as_values
from loomtext.operators.history import assemble_prompts
from loomtext.operators.reducing import (
    NO_SHRINKING,
    fold_sections,
    map_reduce_answer,
    reduce_answers,
    tree_reduce,
)
from loomtext.operators.requests import route_model, validate_requests, zip_results
from loomtext.operators.trajectories import run_summary
from loomtext.plans.iterate import asking_step, batch_complete, quoted_requests
from loomtext.scratch import scratch_path
from loomtext.sources.contexts import split_system, to_messages
from loomtext.sources.runlogs import read_trajectories, write_trajectories

# Workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def prompts(spark, n=20):
    return spark.range(n).select(
        "id", F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt")
    )


def test_echo_and_usage(spark):
    rows = ask(prompts(spark), model="m", concurrency=3).collect()
    assert {r["id"]: r["response"] for r in rows} == {
        i: f"Mock response to: prompt {i}" for i in range(20)
    }
    assert {(r["root_model"], r["calls"], r["input_tokens"], r["output_tokens"]) for r in rows} == {
        ("m", 1, 10, 10)
    }
    assert all(r["error"] is None and r["seconds"] >= 0 for r in rows)
    long = ask(spark.range(1).select("id", F.lit("y" * 80).alias("prompt"))).first()["response"]
    assert long == "Mock response to: " + "y" * 50


class SlowAsyncClient:
    """Counts how many calls are open at once; every fifth call fails."""

    def __init__(self):
        self.open = 0

    async def acomplete(self, prompt, model):
        self.open += 1
        seen = self.open
        await asyncio.sleep(0.01)
        self.open -= 1
        if prompt.endswith("5"):
            raise ValueError("no")
        return Completion(str(seen))


def test_async_client_keeps_its_limit(spark):
    rows = ask(prompts(spark, 40).coalesce(1), SlowAsyncClient, concurrency=3).collect()
    assert {r["id"] for r in rows if r["error"]} == {5, 15, 25, 35}
    assert {r["response"] for r in rows if not r["error"]} == {"1", "2", "3"}


def test_one_failure_leaves_the_rest(spark):
    rows = errors_as_values(ask(prompts(spark), lambda: FailingClient("prompt 7"))).collect()
    answers = {r["id"]: r["answer"] for r in rows}
    assert len(answers) == 20 and answers[7] == "Error: failed" and answers[8].startswith("Mock")
    assert next(r for r in rows if r["id"] == 7)["calls"] is None


def test_batch_atomic(spark):
    batches = prompts(spark).withColumn("batch", F.col("id") % 4)
    asked = ask(batches, lambda: FailingClient("prompt 7"))
    rows = errors_as_values(asked, "batch", batch_atomic=True).collect()
    assert {r["batch"] for r in rows if r["error"]} == {3}
    assert sum(r["error"] is not None for r in rows) == 5


def test_no_result_is_an_error(spark):
    rows = errors_as_values(ask(prompts(spark, 1), lambda: RuleClient(lambda p: None))).collect()
    assert rows[0]["answer"] == "Error: " + NO_RESULT


def test_stored_answers_resume(spark):
    store = scratch_path(spark, "test")
    ask_stored(prompts(spark, 8), "id", store)
    again = ask_stored(
        prompts(spark, 12), "id", store, rounds=3, client=lambda: RuleClient(lambda p: "new")
    )
    answers = {r["id"]: r["response"] for r in again.collect()}
    assert len(answers) == again.count() == 12
    assert {i for i, a in answers.items() if a == "new"} == {8, 9, 10, 11}


def test_messages_and_empty_input(spark):
    listed = spark.range(1).select(
        "id",
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")),
            F.struct(F.lit("user").alias("role"), F.lit("u").alias("content")),
        ).alias("prompt"),
    )
    assert ask(listed).first()["response"] == "Mock response to: s\nu"
    assert ask(prompts(spark).where("id < 0")).count() == 0


def test_model_column_and_routing(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id long, model string")
    registry = spark.createDataFrame([("a",), ("root",)], "model string")
    for limit in (0, 100):
        routed = route_model(requests, registry, "root", broadcast_rows=limit)
        assert {r["id"]: r["routed_model"] for r in routed.collect()} == {1: "a", 2: "root", 3: "root"}
    asked = ask(routed.withColumn("prompt", F.lit("p")), model=F.col("routed_model"), keep=["id"])
    assert {r["root_model"] for r in asked.collect()} == {"a", "root"}


def test_requests(spark):
    rows = spark.createDataFrame(
        [(1, "p", None), (2, "", None), (3, None, []), (4, "p", ["a"]), (5, None, None)],
        "id long, prompt string, prompts array<string>",
    )
    kinds = {r["id"]: r["kind"] for r in validate_requests(rows).collect()}
    assert kinds == {1: "single", 2: "error", 3: "error", 4: "batch", 5: "error"}
    left = spark.createDataFrame([(1, 0), (1, 1)], "b long, pos long")
    right = spark.createDataFrame([(1, 1), (1, 2)], "b long, pos long")
    problems = {r["pos"]: r["problem"] for r in zip_results(left, right, "b", "pos").collect()}
    assert problems == {0: "prompt without result", 1: None, 2: "result without prompt"}


def test_prompt_forms(spark):
    raw = spark.createDataFrame(
        [(1, '"text"'), (2, '[{"role":"user","content":"x"}]'), (3, "5"), (4, '{"a":1}')],
        "id long, raw string",
    ).select("id", F.parse_json("raw").alias("prompt"))
    rows = {r["id"]: r for r in to_messages(raw, "prompt").collect()}
    assert rows[1]["messages"][0]["content"] == "text" and rows[2]["messages"][0]["content"] == "x"
    assert rows[3]["error"] == rows[4]["error"] == "Invalid prompt type"
    turns = spark.createDataFrame(
        [(1, 0, "system", "a"), (1, 1, "user", "u"), (1, 2, "system", "b")],
        "c long, turn long, role string, text string",
    )
    others, system = split_system(turns, "c", "turn", "role", "text")
    assert others.count() == 1 and system.first()["system"] == "b"


def test_template(spark):
    row = spark.createDataFrame([("H", None)], "header string, body string")
    assert row.select(render_prompt("{header}|{query}|{body}.", query="q").alias("p")).first()[0] == "H|q|."


def last20(prompt):
    return f"{len(prompt)}:{prompt[-20:]}"


def parts(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("ctx_id"),
        F.col("id").alias("part_idx"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
    )


def by_context(spark, n):
    grouped = {}
    for r in parts(spark, n).orderBy("part_idx").collect():
        grouped.setdefault(r["ctx_id"], []).append(r["text"])
    return grouped


def test_map_reduce_in_pieces(spark):
    def reduced(texts, budget):
        answers = [last20(t) for t in texts]
        while True:
            pieces, used = {}, 0
            for a in answers:
                pieces.setdefault(used // budget, []).append(a)
                used += len(a) + 1
            answers = [last20("\n".join(p)) for p in pieces.values()]
            if len(answers) == 1:
                return answers[0]

    found = map_reduce_answer(
        parts(spark, 90),
        "q",
        lambda: RuleClient(last20),
        order=["part_idx"],
        chunk="text",
        chunk_template="{chunk}",
        combine_template="{answers}",
        budget=60,
        slice_rows=10,
    ).collect()
    assert {r["ctx_id"]: r["answer"] for r in found} == {
        k: reduced(v, 60) for k, v in by_context(spark, 90).items()
    }


def test_reduce_ends_where_answers_do_not_shrink(spark):
    """Such a key ends with an error; what others have paid for stays."""
    def rule(prompt):
        return prompt if "text" in prompt else prompt[:3]

    answers = parts(spark, 30).withColumnRenamed("text", "answer").unionByName(
        spark.createDataFrame([("short", i, "abcdef") for i in range(4)], "ctx_id string, part_idx long, answer string")
    )
    found = reduce_answers(
        answers, ["ctx_id"], ["part_idx"], "{answers}", "q", lambda: RuleClient(rule), 12
    ).collect()
    by_key = {r["ctx_id"]: r for r in found}
    assert set(by_key) == {"hot", "short", *(f"c{i}" for i in range(5))}
    assert by_key.pop("short")["answer"] == "abc"
    assert all(r["answer"] == f"Error: {NO_SHRINKING}" for r in by_key.values())


@pytest.mark.parametrize("max_depth", [1, 2, 9])
def test_tree(spark, max_depth):
    def reduced(texts):
        depth = 0
        while depth < max_depth:
            depth += 1
            texts = [last20("\n".join(texts[i : i + 4])) for i in range(0, len(texts), 4)]
            if len(texts) == 1:
                return texts[0], depth
        return last20("\n".join(texts)), depth + 1

    found = tree_reduce(
        parts(spark, 60), 4, max_depth, "q", lambda: RuleClient(last20), template="{answers}", slice_rows=10
    ).collect()
    assert {r["ctx_id"]: (r["answer"], r["depth"]) for r in found} == {
        k: reduced(v) for k, v in by_context(spark, 60).items()
    }


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_fold_in_segments(spark, segment):
    def folded(texts):
        buffer = ""
        for i, text in enumerate(texts):
            kind = "L" if i == len(texts) - 1 else str(i)
            buffer = last20(f"{kind}{buffer}|{text}")
        return buffer

    found = fold_sections(
        parts(spark, 40),
        "q",
        lambda: RuleClient(last20),
        step_template="{section_no}{buffer}|{section}",
        last_template="L{buffer}|{section}",
        segment=segment,
        slice_rows=5,
    ).collect()
    assert {r["ctx_id"]: r["buffer"] for r in found} == {
        k: folded(v) for k, v in by_context(spark, 40).items()
    }


def test_long_prompts_are_refused_not_cut(spark):
    history = spark.createDataFrame(
        [(1, 0, 0, "system", "s"), (1, 1, 0, "assistant", "a" * 100), (2, 1, 0, "user", "b")],
        "run_id long, iteration long, seq long, role string, content string",
    )
    due = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "run_id long, iteration long")
    rows = {r["run_id"]: r for r in assemble_prompts(history, due, limit_chars=50).collect()}
    assert rows[1]["prompt"] is None and rows[1]["prompt_error"] == "Prompt too long: 101 characters"
    assert [m["content"] for m in rows[2]["prompt"]] == ["b"] and rows[3]["prompt"] == []
    whole = {r["run_id"]: r for r in assemble_prompts(history, due).collect()}
    assert [m["role"] for m in whole[1]["prompt"]] == ["system", "assistant"]


def test_loop_histories(spark):
    """Every question ends once, and each prompt holds all that came before, in order."""
    questions = spark.createDataFrame(
        [(1, "one"), (2, "two"), (3, None)], "run_id long, question string"
    )

    def reply(prompt):
        if prompt[-1]["content"] == CLOSING_PROMPT:
            return "closing " + "".join(p["role"][0] for p in prompt)
        shape = "".join(p["role"][0] for p in prompt)
        asked = prompt[-1]["content"]
        if '"one"' in asked:
            return f"FINAL({shape})"
        if '"two"' in asked and len(prompt) > 4:
            return f"FINAL({shape})"
        return f"```repl\na = {len(prompt)}\n```\n```repl\nb = 0\n```" if '"two"' in asked else "hm"

    outcome = batch_complete(questions, client=lambda: RuleClient(reply), max_iterations=3)
    rows = {r["run_id"]: r for r in outcome.answers.collect()}
    assert {k: (r["kind"], r["answer"], r["n_iterations"]) for k, r in rows.items()} == {
        1: ("FINAL", "su", 1),
        2: ("FINAL", "sauuu", 2),
        3: ("DEFAULT", "closing saaaa", 3),
    }
    blocks = outcome.iterations.where("run_id = 2 AND iteration = 1").first()["code_blocks"]
    assert [b["code"] for b in blocks] == ["a = 2", "b = 0"]
    assert outcome.iterations.where("run_id = 3").count() == 4


def test_loop_survives_a_failing_model(spark):
    questions = spark.createDataFrame([(1, "bad"), (2, "good")], "run_id long, question string")

    def reply(prompt):
        if '"bad"' in prompt_text(prompt):
            raise ValueError("boom")
        return "FINAL(ok)"

    outcome = batch_complete(questions, client=lambda: RuleClient(reply), max_iterations=2)
    answers = {r["run_id"]: (r["kind"], r["answer"]) for r in outcome.answers.collect()}
    assert answers[2] == ("FINAL", "ok") and answers[1][0] == "DEFAULT"


def test_completion_defaults():
    assert Completion("x").calls == 1
    assert EchoClient().complete("a" * 60, None).response == "Mock response to: " + "a" * 50


def test_reduced_prompts_are_dealt_to_many_tasks(spark):
    """Few bytes, dear in time: adaptive execution must not put all model calls into one task."""
    from pyspark import TaskContext

    from loomtext.models import Completion

    class WhichTask:
        def complete(self, prompt, model=None):
            return Completion(str(TaskContext.get().partitionId()))

    chunks = spark.range(200).select(
        F.col("id").cast("string").alias("ctx_id"), F.lit(0).alias("chunk_idx"), F.lit("x").alias("chunk")
    )
    answers = map_reduce_answer(chunks, "q", WhichTask)
    assert answers.select("answer").distinct().count() >= 4
    folded = fold_sections(
        chunks.select("ctx_id", F.col("chunk_idx").alias("part_idx"), F.col("chunk").alias("text")), "q", WhichTask
    )
    assert folded.select("buffer").distinct().count() >= 3


def test_stored_answers_are_asked_once_per_id(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, prompt string")
    assert ask_stored(rows, "id").count() == 2


def test_reductions_keep_null_keys_and_texts(spark):
    rows = [(k, i, f"text {i}" if i != 2 else None) for k in ("a", None) for i in range(4)]
    parts = spark.createDataFrame(rows, "ctx_id string, part_idx long, text string")
    reduced = tree_reduce(parts, 2, 3, "q").collect()
    assert sorted((str(r["ctx_id"]), r["depth"]) for r in reduced) == [("None", 2), ("a", 2)]
    chunks = parts.select("ctx_id", F.col("part_idx").alias("chunk_idx"), F.col("text").alias("chunk"))
    assert map_reduce_answer(chunks, "q", budget=70).count() == 2
    folded = fold_sections(parts.where("ctx_id = 'a'"), "q", step_template="{buffer}|{section}", last_template="{buffer}|{section}")
    assert "None" not in folded.first()["buffer"]


def test_fold_takes_an_async_client(spark):
    class Later:
        async def acomplete(self, prompt, model=None):
            return Completion(f"<{len(prompt)}>")

    parts = spark.createDataFrame([("a", 0, "x")], "ctx_id string, part_idx long, text string")
    assert fold_sections(parts, "q", Later).first()["buffer"].startswith("<")


class HangingClient:
    """Hangs on some prompts, fails on others, answers the rest."""

    def complete(self, prompt, model):
        if prompt.endswith("7"):
            time.sleep(60)
        if prompt.endswith("3"):
            raise RuntimeError("broken")
        return Completion(prompt.upper(), 1, 2)


class HangingAsyncClient:
    async def acomplete(self, prompt, model):
        if prompt.endswith("7"):
            await asyncio.sleep(60)
        return HangingClient().complete(prompt, model)


@pytest.mark.parametrize("client", [HangingClient, HangingAsyncClient])
@pytest.mark.parametrize("concurrency", [1, 4])
def test_a_hanging_call_ends_as_an_error(spark, client, concurrency):
    started = time.time()
    asked = ask(prompts(spark, 20).coalesce(2), client, concurrency=concurrency, limits=Limits(timeout=0.5))
    rows = {r["prompt_no"]: r for r in asked.select(F.col("id").alias("prompt_no"), "*").collect()}
    assert time.time() - started < 30
    assert len(rows) == 20
    for number, row in rows.items():
        if number % 10 == 7:
            assert row["error"] == "No answer within 0.5 seconds." and row["seconds"] >= 0.4
            assert row["response"] is None and row["calls"] is None
        elif number % 10 == 3:
            assert row["error"] == "broken"
        else:
            assert row["error"] is None and row["response"].endswith(str(number % 10))


class ThirdTimeClient:
    """Answers a prompt at the third attempt."""

    def __init__(self):
        self.attempts = Counter()

    def complete(self, prompt, model):
        self.attempts[prompt] += 1
        if self.attempts[prompt] < 3:
            raise RuntimeError(f"attempt {self.attempts[prompt]}")
        return Completion("done")


class ThirdTimeAsyncClient(ThirdTimeClient):
    async def acomplete(self, prompt, model):
        return self.complete(prompt, model)


@pytest.mark.parametrize("client", [ThirdTimeClient, ThirdTimeAsyncClient])
def test_retries_are_bounded(spark, client):
    for retries, expected in ((1, {("attempt 2", None)}), (2, {(None, "done")})):
        asked = ask(prompts(spark, 12), client, limits=Limits(retries=retries, backoff=0.01))
        assert {(r["error"], r["response"]) for r in asked.collect()} == expected


def test_pauses_are_keyed_and_grow():
    limits = Limits(backoff=2.0)
    assert limits.pause("a", 1) == limits.pause("a", 1) != limits.pause("b", 1)
    for attempt in (1, 2, 3):
        assert 2 ** (attempt - 1) <= limits.pause("a", attempt) / 1.0 <= 3 * 2 ** (attempt - 1)


def test_rate_of_a_task(spark):
    started = time.time()
    asked = ask(prompts(spark, 10).coalesce(1), concurrency=8, limits=Limits(per_second=10.0))
    assert asked.count() == 10
    asked.collect()
    assert time.time() - started > 0.9


class SleepingClient:
    def complete(self, prompt, model):
        time.sleep(0.05)
        return Completion(prompt[-5:], 1, 1)


class SleepingAsyncClient:
    async def acomplete(self, prompt, model):
        await asyncio.sleep(0.05)
        return Completion(prompt[-5:], 1, 1)


@pytest.mark.parametrize("client", [SleepingClient, SleepingAsyncClient])
def test_folds_of_a_task_go_side_by_side(spark, client):
    n = 200
    rows = [(f"c{i}", k, f"text {i} {k}") for i in range(n) for k in range(5)]
    sections = spark.createDataFrame(rows, "ctx_id string, part_idx long, text string")
    fold_sections(sections.limit(5), "q", client).collect()
    started = time.time()
    folded = fold_sections(
        sections, "q", client, step_template="{buffer}|{section}", last_template="{section}", concurrency=32
    )
    found = folded.collect()
    assert time.time() - started < n * 5 * 0.05 / 5
    assert len(found) == n and all(r["n_sections"] == 5 for r in found)
    assert {r["ctx_id"]: r["buffer"] for r in found} == {f"c{i}": f"text {i} 4"[-5:] for i in range(n)}
    assert {tuple(r["usage"]["unknown"]) for r in found} == {(5, 5, 5)}


def test_usage_rides_through_every_round(spark):
    """Two models, missing tokens, failures and NULL keys; calls of all rounds are added up by key."""
    rows = [(None if i % 5 == 0 else f"k{i % 3}", i, f"text {i}") for i in range(40)]
    chunks = spark.createDataFrame(rows, "ctx_id string, chunk_idx long, chunk string")

    def reply(prompt):
        if prompt == "text 7":
            raise ValueError("failed")
        return prompt[:6]

    found = map_reduce_answer(
        chunks, "q", lambda: RuleClient(reply), chunk_template="{chunk}", combine_template="{answers}", budget=21, model="m"
    ).collect()
    assert {r["ctx_id"] for r in found} == {None, "k0", "k1", "k2"}
    expected = {}
    for key, _, text in rows:
        expected.setdefault(key, []).append(text)
    for r in found:
        answers, calls, failed = [], 0, 0
        for text in expected[r["ctx_id"]]:
            bad = text == "text 7"
            calls, failed = calls + (not bad), failed + bad
            answers.append("Error: failed" if bad else reply(text))
        while True:
            pieces, used = {}, 0
            for a in answers:
                pieces.setdefault(used // 21, []).append(a)
                used += len(a) + 1
            answers = [reply("\n".join(p)) for p in pieces.values()]
            calls += len(answers)
            if len(answers) == 1:
                break
        assert tuple(r["usage"]["m"]) == (calls, 10 * calls, 10 * calls)
        assert r["n_errors"] == failed and r["seconds"] >= 0


def test_asking_step_routes_and_records(spark):
    code = 'a = llm_query("say \\"hi\\"\\nnow")\nprint(1)\n  llm_query("back\\\\slash")\nb = llm_query(f"no")\na = llm_query("bad")'
    blocks = spark.createDataFrame(
        [("r", 1, 0, code), ("r", 1, 1, "x = 1"), (None, 2, 0, 'z = llm_query("")')],
        "run_id string, iteration long, block_idx int, code string",
    )
    registry = spark.createDataFrame([("small",)], "model string")

    def wanted(rows):
        return quoted_requests(rows).withColumn("model", F.when(F.col("call_idx") == 0, "small").otherwise("gone"))

    step = asking_step(lambda: FailingClient("bad"), wanted, registry, "large")
    found = {(r["run_id"], r["block_idx"]): r["result"] for r in step(blocks).collect()}
    first = found["r", 0]
    assert [c["prompt"] for c in first["rlm_calls"]] == ['say "hi"\nnow', "back\\slash", "bad"]
    assert [c["root_model"] for c in first["rlm_calls"]] == ["small", "large", "large"]
    answers = [c["response"] for c in first["rlm_calls"]]
    assert answers == ['Mock response to: say "hi"\nnow', "Mock response to: back\\slash", "Error: failed"]
    assert first["stdout"] == "\n".join(answers)
    assert {k: v.toPython() for k, v in first["locals"].items()} == {"a": "Error: failed"}
    assert first["rlm_calls"][0]["usage"]["small"]["total_calls"] == 1
    assert found["r", 1]["rlm_calls"] == [] and found["r", 1]["stdout"] == ""
    assert [c["prompt"] for c in found[None, 0]["rlm_calls"]] == [""]


def test_loop_to_log_to_summary(spark, tmp_path):
    questions = spark.createDataFrame(
        [("one", "how many?", "ctx"), ("never", "", None)], "run_id string, question string, context_line string"
    )

    def reply(prompt):
        if "how many?" not in prompt[-1]["content"]:
            return "no end"
        done = any(p["content"].startswith("Code executed:") for p in prompt)
        return "FINAL_VAR(n)" if done else '```repl\nn = llm_query("count")\n```'

    outcome = batch_complete(
        questions, asking_step(EchoClient, default_model="sub"), lambda: RuleClient(reply), max_iterations=2, model="root"
    )
    answers = {r["run_id"]: r for r in outcome.answers.collect()}
    assert answers["one"]["answer"] == "Mock response to: count"
    assert {m: u["total_calls"] for m, u in answers["one"]["usage"].items()} == {"root": 2, "sub": 1}
    assert {m: u["total_calls"] for m, u in answers["never"]["usage"].items()} == {"root": 3}
    path = str(tmp_path / "logs")
    write_trajectories(outcome.configs, outcome.logged(), path, packed=True)
    configs, iterations, bad = read_trajectories(spark, path)
    assert bad.count() == 0
    assert {(r["run_id"], r["root_model"], r["max_iterations"]) for r in configs.collect()} == {
        ("one", "root", 2), ("never", "root", 2),
    }
    rows = {(r["run_id"], r["iteration"]): r for r in iterations.collect()}
    assert set(rows) == {("one", 1), ("one", 2), ("never", 1), ("never", 2), ("never", 3)}
    first, second = rows["one", 1], rows["one", 2]
    assert [m["role"] for m in first["prompt"]] == ["system", "assistant", "user"]
    assert [m["role"] for m in second["prompt"]] == ["system", "assistant", "assistant", "user", "user"]
    assert second["prompt"][2]["content"] == first["response"]
    assert first["code_blocks"][0]["result"]["rlm_calls"][0]["prompt"] == "count"
    assert rows["never", 3]["prompt"][-1]["content"] == CLOSING_PROMPT
    assert all(r["ts"] is not None and r["iteration_time"] >= 0 for r in rows.values())
    summary = {r["run_id"]: r for r in run_summary(iterations).collect()}
    assert (summary["one"]["n_iterations"], summary["one"]["n_calls"], summary["one"]["completed"]) == (2, 1, True)
    assert summary["never"]["final_answer"] == "no end"


def test_failed_stored_answers_are_asked_again(spark):
    store = scratch_path(spark, "store")
    first = ask_stored(prompts(spark, 12), "id", store, client=lambda: FailingClient("1"))
    before = {r["id"]: r["error"] for r in first.collect()}
    assert set(before) == set(range(12)) and {i for i, e in before.items() if e} == {1, 10, 11}
    then = {r["id"]: r for r in ask_stored(prompts(spark, 14), "id", store, client=lambda: FailingClient("11")).collect()}
    assert set(then) == set(range(14)) and {i for i, r in then.items() if r["error"]} == {11}
    last = ask_stored(prompts(spark, 14), "id", store, client=lambda: FailingClient("never"))
    assert last.where("error IS NOT NULL").count() == 0 and last.count() == 14


class TracedClient:
    """Answers with the peak of Python memory since the first call and a text as long as the prompt."""

    def complete(self, prompt, model):
        if not tracemalloc.is_tracing():
            tracemalloc.start()
        return Completion(f"{tracemalloc.get_traced_memory()[1]}:{'x' * len(prompt)}", 1, 1)


def test_a_task_holds_a_slice_of_a_batch_as_python_objects(spark):
    # One Arrow batch of 40 MB, answered by as many bytes.
    prompts = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("p"), 100_000).alias("prompt"))
    asked = ask(prompts, TracedClient, concurrency=4)
    peak = F.split("response", ":")[0].cast("long")
    row = asked.agg(F.max(peak), F.sum(F.length("response") - F.instr("response", ":")), F.count("id")).first()
    assert row[0] < 30_000_000 and tuple(row)[1:] == (40_000_000, 400)
    # Calls of the next slice begin before the last of this one has ended, and rows keep their own answers.
    told = ask(prompts.withColumn("prompt", F.concat(F.col("id").cast("string"), F.lit(" "), "prompt")), EchoClient)
    assert told.where(~F.col("response").startswith(F.concat(F.lit("Mock response to: "), "id", F.lit(" ")))).isEmpty()
