"""Answer many questions at once: ask, extract, step, append, one Spark round per iteration.

Questions are rows, so a round is a handful of Spark jobs however many there are. Each round's answers
and messages are written to Parquet, which cuts lineage and keeps models from being asked again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.extract import code_blocks, final_answer
from loomtext.functions.messages import CLOSING_PROMPT, MESSAGES, turn_prompt
from loomtext.models import ClientFactory, EchoClient
from loomtext.operators.asking import ask, completion_struct, errors_as_values
from loomtext.operators.history import HISTORY_COLUMNS, assemble_prompts, history_of
from loomtext.operators.requests import route_model, still_active
from loomtext.operators.trajectories import explode_locals
from loomtext.operators.usage import USAGE_COLUMNS, UsageLedger
from loomtext.operators.variables import latest_variables, resolve_answers
from loomtext.schema import BLOCK, CALL, RESULT
from loomtext.scratch import materialise, scratch_path

# Turns extracted blocks (run_id, iteration, block_idx, code) into the same rows with ``result``.
Step = Callable[[DataFrame], DataFrame]

DEFAULT_SYSTEM = (
    "Answer the question from the context. Request work in ```repl``` blocks, and give the answer as "
    "FINAL(answer) or FINAL_VAR(name)."
)

ITERATION_COLUMNS = [
    "run_id",
    "iteration",
    "response",
    "code_blocks",
    "final_kind",
    "final_answer",
    "root_model",
    "calls",
    "input_tokens",
    "output_tokens",
    "seconds",
    "error",
    "ts",
    "iteration_time",
]
LOG_COLUMNS = [
    "run_id", "iteration", "ts", "prompt", "response", "code_blocks", "final_answer", "final_kind", "iteration_time",
]


@dataclass(frozen=True)
class Outcome:
    """``answers`` has one row per question, with the usage of its calls and sub-calls, ``iterations`` one per
    turn, ``configs`` one per run; ``questions`` and ``history`` are what prompts were made of."""

    answers: DataFrame
    iterations: DataFrame
    configs: DataFrame
    questions: DataFrame
    history: DataFrame

    def logged(self) -> DataFrame:
        """The iterations in the run-log schema, each with the whole prompt it answered, for
        ``write_trajectories`` with ``configs``. Prompts repeat a run's history; they are put together only here."""
        turns = self.iterations.select(F.col("run_id").alias("_run"), F.col("iteration").alias("_turn"))
        same = (F.col("run_id") == F.col("_run")) & (F.col("iteration") < F.col("_turn"))
        earlier = self.history.join(turns, same)
        message = F.struct("iteration", "seq", "role", "content")
        in_order = F.array_sort(F.collect_list(message))
        prompts = earlier.groupBy("_run", "_turn").agg(in_order.alias("_m")).select(
            F.col("_run").alias("run_id"),
            F.col("_turn").alias("iteration"),
            F.transform("_m", lambda m: F.struct(m["role"], m["content"])).cast(MESSAGES).alias("_earlier"),
        )
        # A closing answer has no code blocks and no kind.
        closing = F.col("final_kind").isNull() & F.col("final_answer").isNotNull()
        own = F.when(
            closing, F.struct(F.lit("assistant").alias("role"), F.lit(CLOSING_PROMPT).alias("content"))
        ).otherwise(
            F.struct(
                F.lit("user").alias("role"),
                turn_prompt(F.col("iteration") - 1, F.col("question")).alias("content"),
            )
        )
        rows = self.iterations.join(prompts, ["run_id", "iteration"], "left").join(
            self.questions.select("run_id", "question"), "run_id", "left"
        )
        none = F.array().cast(MESSAGES)
        whole = F.concat(F.coalesce("_earlier", none), F.array(own).cast(MESSAGES))
        return rows.withColumn("prompt", whole).select(*LOG_COLUMNS)


def no_step(blocks: DataFrame) -> DataFrame:
    """A step that runs nothing: every block has an empty result."""
    empty = F.struct(
        F.lit("").alias("stdout"),
        F.lit("").alias("stderr"),
        F.create_map().cast("map<string,variant>").alias("locals"),
        F.lit(0.0).alias("execution_time"),
        F.array().alias("rlm_calls"),
    )
    return blocks.withColumn("result", empty.cast(RESULT))


#: A sub-call in a block: the name it assigns, if any, and the quoted prompt.
SUBCALL = r'(?m)^[ \t]*(?:(\w+)[ \t]*=[ \t]*)?{function}\("((?:[^"\\]|\\.)*)"\)'


def quoted_requests(blocks: DataFrame, function: str = "llm_query") -> DataFrame:
    """(run_id, iteration, block_idx, call_idx, name, prompt) of every line of a block that calls ``function`` with
    a text in double quotes, where \\n, \\" and \\\\ stand for a line feed, a quote and a backslash."""
    pattern = SUBCALL.replace("{function}", function)
    names = F.regexp_extract_all("code", F.lit(pattern), F.lit(1))
    prompts = F.regexp_extract_all("code", F.lit(pattern), F.lit(2))
    found = blocks.select(
        "run_id", "iteration", "block_idx",
        F.posexplode(F.arrays_zip(names.alias("name"), prompts.alias("prompt"))).alias("call_idx", "_c"),
    )
    hidden = F.replace(F.col("_c.prompt"), F.lit("\\\\"), F.lit("\0"))
    plain = F.replace(F.replace(hidden, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return found.select(
        "run_id", "iteration", "block_idx", "call_idx",
        F.nullif(F.col("_c.name"), F.lit("")).alias("name"),
        F.replace(plain, F.lit("\0"), F.lit("\\")).alias("prompt"),
    )


def asking_step(
    client: ClientFactory = EchoClient,
    requests: Callable[[DataFrame], DataFrame] = quoted_requests,
    registry: DataFrame | None = None,
    default_model: str | None = None,
    **options,
) -> Step:
    """A step that makes the sub-calls of all blocks of a round at once and records them.

    ``requests`` turns blocks into rows (run_id, iteration, block_idx, call_idx, prompt), optionally with ``name``, the
    variable that takes the answer, and ``model``. With a ``registry`` a model that it does not list gives way
    to ``default_model``. A failed call's answer is its error text. A block's answers are its output.
    """
    ids = ["run_id", "iteration", "block_idx"]

    def step(blocks: DataFrame) -> DataFrame:
        wanted = requests(blocks)
        for column in ("name", "model"):
            if column not in wanted.columns:
                wanted = wanted.withColumn(column, F.lit(None).cast("string"))
        if registry is not None:
            wanted = route_model(wanted, registry, default_model).drop("model")
            wanted = wanted.withColumnRenamed("routed_model", "model")
        else:
            wanted = wanted.withColumn("model", F.coalesce("model", F.lit(default_model).cast("string")))
        spread = {"partitions": blocks.sparkSession.sparkContext.defaultParallelism, **options}
        asked = ask(
            wanted.withColumn("_asked", F.col("prompt")), client, model=F.col("model"),
            keep=[*ids, "call_idx", "name", "_asked"], **spread,
        )
        answered = materialise(errors_as_values(asked), "subcalls")
        record = completion_struct(F.col("_asked")).withField("response", F.col("answer")).cast(CALL)
        calls = F.array_sort(
            F.collect_list(F.struct("call_idx", "name", "answer", record.alias("call"))), _by_call
        )
        per_block = answered.groupBy(*ids).agg(calls.alias("_calls")).select(
            *[F.col(c).alias(f"_{c}") for c in ids], "_calls"
        )
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids]
        made = F.coalesce("_calls", F.array().cast(per_block.schema["_calls"].dataType))
        # The last of several assignments to a name holds.
        named = F.filter("_made", lambda c: c["name"].isNotNull())
        last = F.filter(
            named,
            lambda c, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda d: d["name"] == c["name"]),
        )
        pairs = F.transform(last, lambda c: F.struct(c["name"], c["answer"].cast("variant")))
        spent = F.transform("_made", lambda c: F.coalesce(c["call"]["execution_time"], F.lit(0.0)))
        result = F.struct(
            F.array_join(F.col("_made.answer"), "\n").alias("stdout"),
            F.lit("").alias("stderr"),
            F.map_from_entries(pairs).alias("locals"),
            F.aggregate(spent, F.lit(0.0), lambda a, x: a + x).alias("execution_time"),
            F.col("_made.call").alias("rlm_calls"),
        )
        joined = blocks.join(per_block, same, "left").withColumn("_made", made)
        return joined.select(*blocks.columns, result.cast(RESULT).alias("result"))

    return step


def _by_call(left, right):
    return left["call_idx"] - right["call_idx"]


def _start_messages(questions: DataFrame, system: str) -> DataFrame:
    """System message, then the line that describes the context where there is one."""
    described = (
        F.col("context_line") if "context_line" in questions.columns else F.lit(None).cast("string")
    )
    messages = F.array_compact(
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
            F.when(
                described.isNotNull(),
                F.struct(F.lit("assistant").alias("role"), described.alias("content")),
            ),
        )
    )
    return questions.select(
        "run_id",
        F.lit(0).cast("long").alias("iteration"),
        F.posexplode(messages).alias("seq", "message"),
    ).select(
        "run_id",
        "iteration",
        F.col("seq").cast("long").alias("seq"),
        F.col("message.role").alias("role"),
        F.col("message.content").alias("content"),
    )


def _with_results(asked: DataFrame, step: Step) -> DataFrame:
    """Attach each response's code blocks and the step's results for them."""
    blocks = asked.select(
        "run_id", "iteration", F.posexplode(code_blocks(F.col("answer"))).alias("block_idx", "code")
    )
    stepped = step(blocks).select("run_id", "iteration", "block_idx", "code", "result")
    block = F.struct("code", "result").alias("block")
    in_order = F.array_sort(F.collect_list(F.struct("block_idx", block)), _by_index)
    nested = (
        stepped.groupBy("run_id", "iteration")
        .agg(in_order.alias("_b"))
        .select("run_id", "iteration", F.col("_b.block").alias("code_blocks"))
    )
    return asked.join(nested, ["run_id", "iteration"], "left").withColumn(
        "code_blocks", F.coalesce("code_blocks", F.array().cast(f"array<{BLOCK}>"))
    )


def _block_seconds():
    spent = F.transform("code_blocks", lambda b: F.coalesce(b["result"]["execution_time"], F.lit(0.0)))
    return F.aggregate(spent, F.lit(0.0), lambda a, x: a + x)


def _by_index(left, right):
    return left["block_idx"] - right["block_idx"]


def batch_complete(
    questions: DataFrame,
    step: Step = no_step,
    client: ClientFactory = EchoClient,
    max_iterations: int = 30,
    system: str = DEFAULT_SYSTEM,
    output_limit: int = 20_000,
    model: str | None = None,
    **options,
) -> Outcome:
    """Run the loop for all ``questions`` (run_id, question, optionally context_line).

    Answers have (run_id, kind, answer, error, n_iterations, usage, seconds, n_errors); kind is FINAL,
    FINAL_VAR (resolved from the variables the steps left), or DEFAULT for the closing answer of questions
    that ran out of turns. Usage, seconds and failures are those of all turns and their sub-calls.
    """
    spark = questions.sparkSession
    store = scratch_path(spark, "rounds")
    questions = materialise(questions, "questions")
    history_schema = _start_messages(questions, system).schema
    _start_messages(questions, system).select(*HISTORY_COLUMNS).write.parquet(
        f"{store}/history/round=0"
    )

    def rounds(kind: str, schema, first: int, last: int) -> DataFrame:
        """All rounds so far in one scan, so that plans stay the same size however many there are."""
        paths = [f"{store}/{kind}/round={n}" for n in range(first, last + 1)]
        return spark.read.schema(schema).parquet(*paths)

    # Prompts are few bytes and dear in time: deal them to all cores, not by size.
    options = {"partitions": spark.sparkContext.defaultParallelism, **options}
    active = questions
    for turn in range(max_iterations):
        history = rounds("history", history_schema, 0, turn)
        due = active.select(
            "run_id",
            F.lit(turn + 1).cast("long").alias("iteration"),
            turn_prompt(F.lit(turn), F.col("question")).alias("_turn"),
        )
        prompts = assemble_prompts(history, due, limit_chars=None).withColumn(
            "prompt",
            F.concat(
                "prompt",
                F.array(F.struct(F.lit("user").alias("role"), F.col("_turn").alias("content"))),
            ),
        )
        asked = materialise(
            errors_as_values(ask(prompts.drop("_turn", "prompt_error"), client, model=model, **options)), "turn"
        )
        answer = final_answer(F.col("answer"))
        rows = (
            _with_results(asked, step)
            .withColumn("_final", answer)
            .withColumn("response", F.col("answer"))
            .withColumn("final_kind", F.col("_final.kind"))
            .withColumn("final_answer", F.col("_final.content"))
            .withColumn("ts", F.current_timestamp().cast("timestamp_ntz"))
            .withColumn("iteration_time", F.col("seconds") + _block_seconds())
            .select(*ITERATION_COLUMNS)
        )
        rows.write.parquet(f"{store}/iterations/round={turn + 1}")
        iterations = rounds("iterations", rows.schema, 1, turn + 1)
        open_rows = rounds("iterations", rows.schema, turn + 1, turn + 1).where(
            F.col("final_kind").isNull()
        )
        if open_rows.isEmpty():
            active = None
            break
        finished = iterations.where(F.col("final_kind").isNotNull())
        active = still_active(questions, finished, "run_id")
        history_of(open_rows, output_limit).select(*HISTORY_COLUMNS).write.parquet(
            f"{store}/history/round={turn + 1}"
        )
    finals = iterations.where(F.col("final_kind").isNotNull()).select(
        "run_id",
        F.col("final_kind").alias("kind"),
        F.col("final_answer").alias("content"),
        F.col("iteration").alias("n_iterations"),
    )
    answers = _resolved(finals, iterations)
    if active is not None:
        history = rounds("history", history_schema, 0, max_iterations)
        closing = default_answers(active, history, max_iterations, client, model, **options)
        answers = answers.unionByName(
            closing.select(
                "run_id",
                F.lit("DEFAULT").alias("kind"),
                F.col("response").alias("answer"),
                F.lit(None).cast("string").alias("error"),
                F.lit(max_iterations).cast("long").alias("n_iterations"),
            )
        )
        iterations = iterations.unionByName(closing.select(*ITERATION_COLUMNS))
    ledger = UsageLedger(["run_id"])
    ledger.add(iterations)
    subcalls = iterations.select("run_id", F.explode("code_blocks").alias("_b")).select(
        "run_id", F.explode("_b.result.rlm_calls").alias("_c")
    )
    failed = F.coalesce(F.col("_c.response").startswith("Error: "), F.lit(False))
    ledger.add_maps(
        subcalls.select("run_id", "_c", "_c.usage", F.col("_c.execution_time").alias("_time")), "_time", failed
    )
    configs = questions.select(
        "run_id",
        F.current_timestamp().cast("timestamp_ntz").alias("ts"),
        F.lit(model or "unknown").alias("root_model"),
        F.lit(1).alias("max_depth"),
        F.lit(max_iterations).alias("max_iterations"),
    )
    last = max_iterations if active is not None else turn
    history = rounds("history", history_schema, 0, last)
    return Outcome(ledger.attach(answers), iterations, configs, questions, history)


def _resolved(finals: DataFrame, iterations: DataFrame) -> DataFrame:
    """Replace variable names by the values the variables hold at the end."""
    named = finals.where(F.col("kind") == "FINAL_VAR").select("run_id")
    assigned = explode_locals(iterations.join(named, "run_id", "left_semi")).withColumn(
        "value", F.col("value_text")
    )
    held = latest_variables(assigned, ["iteration", "block_idx"])
    return resolve_answers(finals, held).select(
        "run_id", "kind", "answer", "error", "n_iterations"
    )


def default_answers(
    active: DataFrame,
    history: DataFrame,
    turns: int,
    client: ClientFactory = EchoClient,
    model: str | None = None,
    **options,
) -> DataFrame:
    """One closing prompt per question still open after ``turns``, as iterations without blocks."""
    due = active.select("run_id", F.lit(turns + 1).cast("long").alias("iteration"))
    closing = F.array(
        F.struct(F.lit("assistant").alias("role"), F.lit(CLOSING_PROMPT).alias("content"))
    )
    prompts = assemble_prompts(history, due, limit_chars=None)
    prompts = prompts.withColumn("prompt", F.concat("prompt", closing)).drop("prompt_error")
    asked = materialise(errors_as_values(ask(prompts, client, model=model, **options)), "closing")
    return asked.select(
        "run_id",
        "iteration",
        F.col("answer").alias("response"),
        F.array().cast(f"array<{BLOCK}>").alias("code_blocks"),
        F.lit(None).cast("string").alias("final_kind"),
        F.col("answer").alias("final_answer"),
        "root_model",
        "calls",
        "input_tokens",
        "output_tokens",
        "seconds",
        "error",
        F.current_timestamp().cast("timestamp_ntz").alias("ts"),
        F.col("seconds").alias("iteration_time"),
    )


def complete_or_direct(
    questions: DataFrame,
    max_depth: int = 1,
    prompt: str = "prompt",
    client: ClientFactory = EchoClient,
    **options,
) -> DataFrame:
    """(run_id, kind, answer, usage, seconds, n_errors): questions at ``depth >= max_depth`` get one direct call, others the loop."""
    direct = questions.where(F.col("depth") >= max_depth).select(
        "run_id", F.col(prompt).alias("prompt")
    )
    shared = {k: v for k, v in options.items() if k in ("model", "concurrency", "partitions", "setup", "limits")}
    answered = materialise(errors_as_values(ask(direct, client, **shared)), "direct")
    ledger = UsageLedger(["run_id"])
    ledger.add(answered)
    answered = ledger.attach(answered.select("run_id", F.lit("DIRECT").alias("kind"), "answer"))
    deep = questions.where(F.col("depth") < max_depth)
    looped = batch_complete(deep, client=client, **options).answers
    return looped.select("run_id", "kind", "answer", *USAGE_COLUMNS).unionByName(answered)
