"""Prompting, batched calls, reductions and question loops, with deterministic stand-in models."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions.messages import (
    FIRST_TURN,
    GENERAL_PROMPT,
    LATER_TURN,
    QUESTION_PROMPT,
    render_prompt,
    turn_prompt,
)
from loomtext.models import (
    AsyncDigestClient,
    Completion,
    DigestClient,
    EchoClient,
    FailingClient,
    RuleClient,
    prompt_text,
)
from loomtext.operators.asking import (
    Limits,
    ask,
    ask_stored,
    completion_records,
    completion_struct,
    errors_as_values,
)
from loomtext.operators.chunking import chunk_fixed, section_position
from loomtext.operators.reducing import (
    fold_sections,
    map_reduce_answer,
    section_summaries,
    tree_reduce,
)
from loomtext.operators.requests import (
    expand_requests,
    match_responses,
    route_model,
    still_active,
    validate_requests,
)
from loomtext.operators.trajectories import explode_locals, run_summary
from loomtext.operators.usage import explode_usage
from loomtext.plans.iterate import asking_step, batch_complete, complete_or_direct
from loomtext.schema import RESULT
from loomtext.scratch import materialise, scratch_path
from loomtext.sources.runlogs import read_trajectories, write_trajectories
from loomtext.suite.context_queries import CHUNKS_SQL, doc_parts
from loomtext.suite.fixtures import CALLS_SQL, calls, digest_sql, echo_sql, sql_text, with_ctes
from loomtext.suite.registry import query

QUESTION = "What is said"


def doc_chunks(t):
    chunks = chunk_fixed(t.documents.select("source", "doc_id", "text"), 1000)
    return chunks.withColumnRenamed("source", "ctx_id")


@query(
    "ask1_render_prompt",
    """
    SELECT source, doc_id, md5('Section ' || (rn - 1) || ' of ' || n || CASE WHEN rn = n THEN ' (last)' ELSE '' END || ': ' || text) AS digest
    FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
                 count(*) OVER (PARTITION BY source) AS n FROM documents)
    """,
)
def ask1(t):
    placed = section_position(
        t.documents.select("source", "doc_id", "text"), ["source"], ["doc_id"]
    )
    prompt = F.when(
        F.col("is_last"), render_prompt("Section {section_no} of {n_sections} (last): {text}")
    ).otherwise(render_prompt("Section {section_no} of {n_sections}: {text}"))
    return placed.select("source", "doc_id", F.md5(prompt).alias("digest"))


TURN_SQL = f"""
SELECT conv_id, turn, md5(
  CASE WHEN turn = 0 THEN {sql_text(FIRST_TURN)} ELSE {sql_text(LATER_TURN)} END
  || CASE WHEN role = 'user' THEN replace({sql_text(QUESTION_PROMPT)}, '{{question}}', text)
          ELSE {sql_text(GENERAL_PROMPT)} END) AS digest
FROM conversations
"""


@query("ask2_turn_prompt", TURN_SQL)
def ask2(t):
    question = F.when(F.col("role") == "user", F.col("text"))
    return t.conversations.select(
        "conv_id", "turn", F.md5(turn_prompt(F.col("turn"), question)).alias("digest")
    )


@query(
    "ask3_ask",
    f"""
    SELECT doc_id, 'small' AS root_model, {digest_sql("text")} AS response, CAST(NULL AS VARCHAR) AS error,
      CAST(1 AS BIGINT) AS calls, CAST(10 AS BIGINT) AS input_tokens, CAST(10 AS BIGINT) AS output_tokens
    FROM documents
    """,
)
def ask3(t):
    asked = ask(t.documents.select("doc_id", "text"), DigestClient, prompt="text", model="small")
    return asked.drop("seconds")


@query(
    "ask4_ask_batched",
    f"""
    WITH {CHUNKS_SQL}
    SELECT doc_id, chunk_idx, {digest_sql("('Q: ' || chunk)")} AS response FROM chunks
    """,
)
def ask4(t):
    prompts = doc_chunks(t).select(
        "doc_id", "chunk_idx", render_prompt("Q: {chunk}").alias("prompt")
    )
    return ask(prompts, DigestClient, concurrency=8, partitions=8).select("doc_id", "chunk_idx", "response")


@query(
    "ask4_ask_stored",
    f"SELECT doc_id, {digest_sql('text')} AS response FROM documents",
)
def ask4_stored(t):
    asked = ask_stored(
        t.documents.select("doc_id", "text"), request_id="doc_id", rounds=2, client=DigestClient,
        prompt="text",
    )
    return asked.select("doc_id", "response")


@query(
    "ask4_message_lists",
    f"SELECT conv_id, turn, {digest_sql("('Be brief.' || chr(10) || text)")} AS response FROM conversations",
)
def ask4_messages(t):
    system = F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content"))
    own = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    prompts = t.conversations.select("conv_id", "turn", F.array(system, own).alias("prompt"))
    return ask(prompts, DigestClient).select("conv_id", "turn", "response")


def _event_prompts(t):
    return t.events.select(
        "event_id",
        F.col("user_id").alias("batch_id"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("prompt"),
    )


@query(
    "ask5_errors_as_values",
    f"""
    SELECT event_id, user_id AS batch_id,
      CASE WHEN event_type = 'error' THEN 'failed' END AS error,
      CASE WHEN event_type = 'error' THEN 'Error: failed' ELSE {echo_sql("(event_type || ' ' || event_id)")} END AS answer
    FROM events
    """,
)
def ask5(t):
    asked = ask(_event_prompts(t), lambda: FailingClient("error"))
    return errors_as_values(asked).select("event_id", "batch_id", "error", "answer")


@query(
    "ask5_batch_atomic",
    f"""
    SELECT event_id, batch_id, CASE WHEN bad THEN 'failed' END AS error,
      CASE WHEN bad THEN 'Error: failed' ELSE {echo_sql("prompt")} END AS answer
    FROM (SELECT event_id, event_id // 4 AS batch_id, event_type || ' ' || event_id AS prompt,
                 bool_or(event_type = 'error') OVER (PARTITION BY event_id // 4) AS bad FROM events)
    """,
)
def ask5_atomic(t):
    prompts = _event_prompts(t).withColumn("batch_id", F.floor(F.col("event_id") / 4))
    # The answers are read twice, once to find failed batches, so they are written first.
    asked = ask_stored(prompts, request_id="event_id", client=lambda: FailingClient("error"))
    atomic = errors_as_values(asked, batch="batch_id", batch_atomic=True)
    return atomic.select("event_id", "batch_id", "error", "answer")


@query(
    "ask6_completion_record",
    with_ctes(CALLS_SQL)
    + """
    SELECT call_id, run_id, model, round(s, 2) AS batch_seconds, n AS batch_calls
    FROM calls JOIN (SELECT run_id, sum(seconds) AS s, count(*) AS n FROM calls GROUP BY 1) USING (run_id)
    """,
)
def ask6(t):
    records = completion_records(
        calls(t).select("call_id", "run_id", "model", "seconds"), batch="run_id"
    )
    return records.select(
        "call_id",
        "run_id",
        "model",
        F.round(F.col("execution_time") * F.col("batch_calls"), 2).alias("batch_seconds"),
        "batch_calls",
    )


@query(
    "ask6_completion_struct",
    f"""
    SELECT doc_id, 'm' AS root_model, md5(text) AS digest, {digest_sql("text")} AS response,
      CAST(1 AS BIGINT) AS total_calls, CAST(20 AS BIGINT) AS tokens
    FROM documents
    """,
)
def ask6_struct(t):
    source = t.documents.select("doc_id", "text", F.col("text").alias("prompt"))
    packed = ask(source, DigestClient, model="m").select(
        "doc_id", completion_struct(F.col("text")).alias("c")
    )
    usage = F.col("c.usage")["m"]
    return packed.select(
        "doc_id",
        "c.root_model",
        F.md5("c.prompt").alias("digest"),
        "c.response",
        usage["total_calls"].alias("total_calls"),
        (usage["total_input_tokens"] + usage["total_output_tokens"]).alias("tokens"),
    )


@query(
    "udf1_async_client",
    f"SELECT doc_id, {digest_sql('text')} AS response FROM documents",
)
def udf1(t):
    asked = ask(t.documents.select("doc_id", "text"), AsyncDigestClient, prompt="text")
    return asked.select("doc_id", "response")


@query(
    "udf3_round_step",
    """
    SELECT run_id, CAST(i AS BIGINT) AS block_idx, 'a' || i AS name, CAST(6 AS BIGINT) AS value
    FROM (SELECT conv_id * 1000 + turn AS run_id, unnest(range(2)) AS i FROM conversations)
    """,
)
def udf3(t):
    def reply(prompt):
        done = any(part["content"].startswith("Code executed:") for part in prompt)
        return "FINAL(x)" if done else "```repl\na0 = 0\n```\n```repl\na1 = 1\n```"

    outcome = batch_complete(
        _questions(t), counting_step, lambda: RuleClient(reply), max_iterations=3
    )
    return explode_locals(outcome.iterations).select(
        "run_id",
        "block_idx",
        "name",
        F.try_variant_get("value", "$", "long").alias("value"),
    )


@query(
    "udf4_scripted_model",
    "SELECT doc_id, CAST(length(text) AS VARCHAR) || ':' || reverse(text) AS response FROM documents",
)
def udf4(t):
    client = lambda: RuleClient(lambda prompt: f"{len(prompt)}:{prompt[::-1]}")
    return ask(t.documents.select("doc_id", "text"), client, prompt="text").select("doc_id", "response")


class CountingClient(EchoClient):
    """Client whose answers show that the set-up hook of the task ran before it was built."""

    ready = False

    def complete(self, prompt, model):
        state = "ready" if CountingClient.ready else "not ready"
        return Completion(f"{state} {prompt_text(prompt)}", 1, 1)


def _make_ready():
    CountingClient.ready = True


@query(
    "udf2_setup_hook",
    "SELECT doc_id, 'ready ' || text AS response FROM documents",
)
def udf2(t):
    asked = ask(
        t.documents.select("doc_id", "text"), CountingClient, prompt="text", setup=_make_ready
    )
    return asked.select("doc_id", "response")


@query(
    "flt2_validate_requests",
    """
    SELECT conv_id, turn, kind, CASE WHEN kind = 'error' THEN 'Missing ''prompt'' or ''prompts'' in request.' END AS error
    FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'batch' WHEN turn % 4 <> 1 AND text <> '' THEN 'single' ELSE 'error' END AS kind
          FROM conversations)
    """,
)
def flt2(t):
    return validate_requests(_requests(t)).select("conv_id", "turn", "kind", "error")


def _requests(t):
    return t.conversations.select(
        "conv_id",
        "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.lit(None).cast("string").alias("model"),
        F.when(F.col("turn") % 4 == 1, "").otherwise(F.col("text")).alias("prompt"),
        F.when(F.col("turn") % 3 == 0, F.array("text", "role")).alias("prompts"),
    )


@query(
    "flt2_expand_requests",
    """
    WITH r AS (SELECT conv_id * 1000 + turn AS request_id, turn, text, role FROM conversations)
    SELECT request_id, CAST(0 AS BIGINT) AS pos, text AS prompt FROM r WHERE turn % 3 = 0
    UNION ALL SELECT request_id, 1, role FROM r WHERE turn % 3 = 0
    UNION ALL SELECT request_id, 0, text FROM r WHERE turn % 3 <> 0 AND turn % 4 <> 1 AND text <> ''
    """,
)
def flt2_expand(t):
    expanded = expand_requests(validate_requests(_requests(t)), "request_id")
    return expanded.select("request_id", "pos", "prompt")


@query(
    "jn1_route_model",
    """
    SELECT event_id, event_type AS model,
      CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'root' END AS routed_model
    FROM events
    """,
)
def jn1(t):
    requests = t.events.select("event_id", F.col("event_type").alias("model"))
    registry = requests.where("model NOT IN ('signup', 'error')").select("model").distinct()
    return route_model(requests, registry, default="root")


@query(
    "jn3_still_active",
    """
    SELECT DISTINCT conv_id FROM conversations c
    WHERE NOT EXISTS (SELECT 1 FROM conversations f WHERE f.conv_id = c.conv_id AND f.role = 'system')
    """,
)
def jn3(t):
    questions = t.conversations.select("conv_id").distinct()
    return still_active(questions, t.conversations.where("role = 'system'"), "conv_id")


def _match_sql(seconds: int) -> str:
    return f"""
    WITH q AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'),
    r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
    m AS (SELECT q.user_id, q.event_id AS request_id,
            arg_min(r.event_id, (r.ts, r.event_id)) AS response_id
          FROM q LEFT JOIN r ON r.user_id = q.user_id AND r.ts >= q.ts AND r.ts <= q.ts + to_seconds({seconds})
          GROUP BY 1, 2)
    SELECT user_id, request_id, response_id, CASE WHEN response_id IS NULL THEN 'Request timed out' END AS error FROM m
    """


def _matched(t, seconds):
    def side(kind, name):
        rows = t.events.where(F.col("event_type") == kind)
        return rows.select("user_id", F.col("event_id").alias(name), "ts")

    matched = match_responses(
        side("view", "request_id"), side("click", "response_id"), "user_id", seconds
    )
    return matched.select("user_id", "request_id", "response_id", "error")


@query("jn4_match_responses", _match_sql(300))
def jn4(t):
    return _matched(t, 300)


@query("jn4_match_responses_6h", _match_sql(21_600))
def jn4_long(t):
    return _matched(t, 21_600)


@query(
    "agg9_map_reduce_answer",
    f"""
    WITH {CHUNKS_SQL},
    a AS (SELECT source, string_agg({digest_sql("chunk")}, chr(10) ORDER BY doc_id, chunk_idx) AS answers, count(*) AS n FROM chunks GROUP BY 1)
    SELECT source AS ctx_id, n AS n_chunks, {digest_sql(f"(answers || '{QUESTION}')")} AS answer FROM a
    """,
)
def agg9(t):
    chunks = doc_chunks(t)
    answers = map_reduce_answer(
        chunks,
        QUESTION,
        DigestClient,
        order=["doc_id", "chunk_idx"],
        chunk_template="{chunk}",
        combine_template="{answers}{query}",
    )
    counts = chunks.groupBy("ctx_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return counts.join(answers, "ctx_id").select("ctx_id", "n_chunks", "answer")


def _budget_sql(budget: int, rounds: int = 4) -> str:
    """Reduction in pieces: a key leaves at the first round that has one piece for it."""
    steps, results = [], []
    for n in range(1, rounds + 1):
        order = "doc_id, chunk_idx" if n == 1 else "piece"
        steps.append(
            f"""
    p{n} AS (SELECT *, coalesce(sum(length(answer) + 1) OVER (PARTITION BY lang ORDER BY {order}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {budget} AS next_piece FROM a{n - 1}),
    b{n} AS (SELECT lang, next_piece AS piece, {digest_sql(f"string_agg(answer, chr(10) ORDER BY {order})")} AS answer
             FROM p{n} GROUP BY 1, 2),
    a{n} AS (SELECT * FROM b{n} WHERE lang IN (SELECT lang FROM b{n} WHERE piece > 0))"""
        )
        results.append(
            f"SELECT lang AS ctx_id, answer FROM b{n} WHERE lang NOT IN (SELECT lang FROM a{n})"
        )
    return (
        f"""WITH {CHUNKS_SQL},
    a0 AS (SELECT lang, doc_id, chunk_idx, {digest_sql("chunk")} AS answer
           FROM chunks JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),"""
        + ",".join(steps)
        + "\n"
        + "\nUNION ALL\n".join(results)
    )


@query("agg9_map_reduce_budget", _budget_sql(4000))
def agg9_budget(t):
    chunks = chunk_fixed(t.documents.select(F.col("lang").alias("ctx_id"), "doc_id", "text"), 1000)
    return map_reduce_answer(
        chunks,
        QUESTION,
        DigestClient,
        order=["doc_id", "chunk_idx"],
        chunk_template="{chunk}",
        combine_template="{answers}",
        budget=4000,
    ).select("ctx_id", "answer")


@query(
    "agg10_section_summaries",
    f"""
    WITH s AS (
      SELECT doc_id, regexp_extract_all(text, '### (.+)', 1) AS headers,
             regexp_split_to_array(text, '### .+') AS bodies FROM documents WHERE contains(text, '### ')),
    u AS (SELECT doc_id, headers, bodies, unnest(range(len(headers))) AS i FROM s),
    x AS (SELECT doc_id, i, headers[i + 1] AS header, headers[i + 1] || bodies[i + 2] AS prompt FROM u),
    j AS (SELECT doc_id, string_agg(header || ': ' || {digest_sql("prompt")}, chr(10) ORDER BY i) AS answers FROM x GROUP BY 1)
    SELECT doc_id, {digest_sql("answers")} AS answer FROM j
    """,
)
def agg10(t):
    return section_summaries(
        t.documents.select("doc_id", "text"),
        QUESTION,
        DigestClient,
        key="doc_id",
        section_template="{header}{body}",
        combine_template="{answers}",
    ).select("doc_id", "answer")


def _tree_sql(fan_in: int, max_depth: int) -> str:
    """Reduction in levels: a key leaves at the first level that has one group for it."""
    steps, results = [], []
    for n in range(1, max_depth + 1):
        steps.append(
            f"""
    b{n} AS (SELECT source, i // {fan_in} AS i, {digest_sql("string_agg(x, chr(10) ORDER BY i)")} AS x
             FROM a{n - 1} GROUP BY 1, i // {fan_in}),
    a{n} AS (SELECT * FROM b{n} WHERE source IN (SELECT source FROM b{n} WHERE i > 0))"""
        )
        results.append(
            f"SELECT source AS ctx_id, x AS answer, CAST({n} AS BIGINT) AS depth FROM b{n} "
            f"WHERE source NOT IN (SELECT source FROM a{n})"
        )
    return (
        """WITH a0 AS (SELECT source, text AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i
           FROM documents),"""
        + ",".join(steps)
        + "\n"
        + "\nUNION ALL\n".join(results)
    )


@query("agg11_tree_reduce", _tree_sql(8, 5))
def agg11(t):
    reduced = tree_reduce(doc_parts(t), 8, 5, QUESTION, DigestClient, template="{answers}")
    return reduced.select("ctx_id", "answer", "depth")


@query(
    "agg11_tree_reduce_bound",
    f"""
    WITH p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, text FROM documents),
    a AS (SELECT source, i // 8 AS i, {digest_sql("string_agg(text, chr(10) ORDER BY i)")} AS x FROM p GROUP BY 1, i // 8)
    SELECT source AS ctx_id, {digest_sql("string_agg(x, chr(10) ORDER BY i)")} AS answer, CAST(2 AS BIGINT) AS depth
    FROM a GROUP BY 1
    """,
)
def agg11_bound(t):
    reduced = tree_reduce(doc_parts(t), 8, 1, QUESTION, DigestClient, template="{answers}")
    return reduced.select("ctx_id", "answer", "depth")


@query(
    "agg12_fold_sections",
    f"""
    WITH RECURSIVE p AS (
      SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
             count(*) OVER (PARTITION BY source) AS n FROM documents),
    f AS (
      SELECT source, i, n, {digest_sql("(i || '/' || n || '|' || text)")} AS buffer FROM p WHERE i = 0
      UNION ALL
      SELECT p.source, p.i, p.n, CASE WHEN p.i = p.n - 1
          THEN {digest_sql("('last' || f.buffer || '|' || p.text)")}
          ELSE {digest_sql("(p.i || '/' || p.n || f.buffer || '|' || p.text)")} END
      FROM f JOIN p ON p.source = f.source AND p.i = f.i + 1)
    SELECT source AS ctx_id, n AS n_sections, buffer FROM f WHERE i = n - 1
    """,
)
def agg12(t):
    return _folded(t).select("ctx_id", "n_sections", "buffer")


def _folded(t):
    return fold_sections(
        doc_parts(t),
        QUESTION,
        DigestClient,
        step_template="{section_no}/{n_sections}{buffer}|{section}",
        last_template="last{buffer}|{section}",
        model="m",
    )


@query(
    "agg12_usage",
    """
    SELECT source AS ctx_id, 'm' AS model, count(*) AS total_calls, 10 * count(*) AS input_tokens,
           10 * count(*) AS output_tokens, CAST(0 AS BIGINT) AS n_errors
    FROM documents GROUP BY 1
    """,
)
def agg12_usage(t):
    folded = _folded(t)
    return explode_usage(folded, ["ctx_id", "n_errors"])


@query(
    "agg9_usage",
    f"""
    WITH {CHUNKS_SQL},
    rounds AS (
      SELECT source, count(*) AS n, count(*) FILTER (WHERE contains(chunk, 'e')) AS bad FROM chunks GROUP BY 1)
    SELECT source AS ctx_id, 'm' AS model, n - bad + 1 AS total_calls, 10 * (n - bad + 1) AS input_tokens,
           10 * (n - bad + 1) AS output_tokens, bad AS n_errors
    FROM rounds
    """,
)
def agg9_usage(t):
    """Every call of a key counts, that of its chunks and the one that combines them; failed ones cost nothing."""
    answers = map_reduce_answer(
        doc_chunks(t), QUESTION, lambda: FailingClient("e"), order=["doc_id", "chunk_idx"],
        chunk_template="{chunk}", combine_template="all", model="m",
    )
    return explode_usage(answers, ["ctx_id", "n_errors"])


class FlakyClient(DigestClient):
    """Fails on the first attempt at a prompt."""

    def __init__(self):
        self.seen = set()

    def complete(self, prompt, model):
        text = prompt_text(prompt)
        if text not in self.seen:
            self.seen.add(text)
            raise ConnectionError("try again")
        return super().complete(prompt, model)


@query(
    "ask4_retry",
    f"""
    SELECT doc_id, CASE WHEN contains(text, '!') THEN 'failed' END AS first_error,
           {digest_sql("text")} AS response, CAST(NULL AS VARCHAR) AS error
    FROM documents
    """,
)
def ask4_retry(t):
    """A first run leaves failures in the store; a second asks them again, with a retry each."""
    store = scratch_path(t.spark, "retry")
    prompts = t.documents.select("doc_id", F.col("text").alias("prompt"))
    first = ask_stored(prompts, "doc_id", store, client=lambda: FailingClient("!", DigestClient()))
    failed = materialise(first.select("doc_id", F.col("error").alias("first_error")), "failed")
    limits = Limits(retries=1, backoff=0.0)
    then = ask_stored(prompts, "doc_id", store, client=FlakyClient, limits=limits)
    return then.select("doc_id", "response", "error").join(failed, "doc_id")


def scripted_reply(prompt) -> str:
    """Works for as many turns as the question's length says, then answers with its digest."""
    question = prompt[1]["content"]
    done = sum(part["content"].startswith("Code executed:") for part in prompt)
    if done < len(question) % 4:
        return f"Turn {done}\n```repl\nn{done} = {done}\n```"
    if len(question) % 8 >= 4:
        return "FINAL_VAR('n0')" if done else "FINAL_VAR(missing)"
    return f"FINAL({DigestClient().complete(question, None).response})"


def counting_step(blocks):
    """A step that 'runs' a block by storing the length of its code under the name it assigns."""
    name = F.regexp_extract("code", r"^(\w+) =", 1)
    result = F.struct(
        F.concat(F.lit("ran "), F.length("code").cast("string")).alias("stdout"),
        F.lit("").alias("stderr"),
        F.create_map(name, F.length("code").cast("long").cast("variant")).alias("locals"),
        F.lit(0.5).alias("execution_time"),
        F.array().alias("rlm_calls"),
    )
    return blocks.withColumn("result", result.cast(RESULT))


def _questions(t):
    """Every turn of every conversation is the context of a question."""
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"),
        F.lit("Say something.").alias("question"),
        F.col("text").alias("context_line"),
    )


LOOP_SQL = f"""
q AS (SELECT conv_id * 1000 + turn AS run_id, text, length(text) % 4 AS turns, length(text) % 8 >= 4 AS variable
      FROM conversations),
done AS (
  SELECT run_id, CASE WHEN turns >= {{limit}} THEN 'DEFAULT' WHEN variable THEN 'FINAL_VAR' ELSE 'FINAL' END AS kind,
    CASE WHEN turns >= {{limit}} AND turns > {{limit}} THEN 'Turn ' || {{limit}} || chr(10) || '```repl' || chr(10) || 'n' || {{limit}} || ' = ' || {{limit}} || chr(10) || '```'
      WHEN turns >= {{limit}} AND variable THEN CASE WHEN {{limit}} > 0 THEN 'FINAL_VAR(''n0'')' ELSE 'FINAL_VAR(missing)' END
      WHEN turns >= {{limit}} THEN 'FINAL(' || {digest_sql("text")} || ')'
      WHEN variable THEN CASE WHEN turns > 0 THEN '6' END
      ELSE {digest_sql("text")} END AS answer,
    CASE WHEN turns < {{limit}} AND variable AND turns = 0 THEN 'Error: Variable ''missing'' not found' END AS error,
    CAST(CASE WHEN turns >= {{limit}} THEN {{limit}} ELSE turns + 1 END AS BIGINT) AS n_iterations
  FROM q)
"""
ANSWER_COLUMNS = ["run_id", "kind", "answer", "error", "n_iterations"]


def _looped(t, limit):
    return batch_complete(
        _questions(t), counting_step, lambda: RuleClient(scripted_reply), max_iterations=limit
    )


@query(
    "itr1_batch_complete",
    "WITH " + LOOP_SQL.format(limit=5) + "SELECT run_id, kind, answer, error, n_iterations FROM done",
)
def itr1(t):
    return _looped(t, 5).answers.select(*ANSWER_COLUMNS)


@query(
    "itr1_usage",
    "WITH "
    + LOOP_SQL.format(limit=2)
    + """
    SELECT run_id, 'unknown' AS model, n AS total_calls, 10 * n AS input_tokens, 10 * n AS output_tokens,
      CAST(0 AS BIGINT) AS n_errors
    FROM (SELECT run_id, CASE WHEN kind = 'DEFAULT' THEN n_iterations + 1 ELSE n_iterations END AS n FROM done)
    """,
)
def itr1_usage(t):
    return explode_usage(_looped(t, 2).answers, ["run_id", "n_errors"])


def _asking_reply(prompt) -> str:
    """Asks two sub-questions about the context in its first turn, then answers with what came back."""
    last = prompt[-2]["content"]
    if not last.startswith("Code executed:"):
        return "```repl\nfirst = llm_query(\"one \\\"%s\\\"\")\nllm_query(\"two\")\n```" % len(prompt[1]["content"])
    return f"FINAL({last.split('REPL output:')[1].strip().splitlines()[0]})"


def _asked_runs(t):
    step = asking_step(DigestClient, default_model="small")
    return batch_complete(
        _questions(t), step, lambda: RuleClient(_asking_reply), max_iterations=3, model="large"
    )


@query(
    "itr1_subcalls",
    f"""
    SELECT conv_id * 1000 + turn AS run_id, 'FINAL' AS kind,
      {digest_sql("('one ' || chr(34) || length(text) || chr(34))")} AS answer, 'large' AS model,
      CAST(2 AS BIGINT) AS total_calls FROM conversations
    UNION ALL
    SELECT conv_id * 1000 + turn, 'FINAL', {digest_sql("('one ' || chr(34) || length(text) || chr(34))")}, 'small',
      2 FROM conversations
    """,
)
def itr1_subcalls(t):
    spent = explode_usage(_asked_runs(t).answers, ["run_id", "kind", "answer"])
    return spent.select("run_id", "kind", "answer", "model", "total_calls")


@query(
    "itr1_logged_summary",
    f"""
    SELECT conv_id * 1000 + turn AS run, CAST(2 AS BIGINT) AS n_iterations, CAST(1 AS BIGINT) AS n_blocks,
      CAST(2 AS BIGINT) AS n_calls, false AS has_errors, true AS completed,
      {digest_sql("('one ' || chr(34) || length(text) || chr(34))")} AS final_answer
    FROM conversations
    """,
)
def itr1_logged(t):
    """The loop's log is written, read back and rolled up."""
    outcome = _asked_runs(t)
    path = scratch_path(t.spark, "logs")
    text_id = F.col("run_id").cast("string")
    write_trajectories(
        outcome.configs.withColumn("run_id", text_id), outcome.logged().withColumn("run_id", text_id), path, packed=True
    )
    _, iterations, _ = read_trajectories(t.spark, path)
    return run_summary(iterations).select(
        F.col("run_id").cast("long").alias("run"), "n_iterations", "n_blocks", "n_calls",
        "has_errors", "completed", "final_answer",
    )


@query(
    "itr2_default_answers",
    "WITH " + LOOP_SQL.format(limit=2) + "SELECT run_id, kind, answer, error, n_iterations FROM done",
)
def itr2(t):
    return _looped(t, 2).answers.select(*ANSWER_COLUMNS)


@query(
    "itr2_default_iterations",
    "WITH "
    + LOOP_SQL.format(limit=2)
    + """
    SELECT run_id, CAST(i AS BIGINT) AS iteration, CAST(CASE WHEN i <= least(turns, 2) THEN 1 ELSE 0 END AS BIGINT) AS n_blocks,
      i > least(turns, 2) AS answered
    FROM (SELECT run_id, turns, unnest(range(1, CAST(least(turns, 2) + 2 AS BIGINT))) AS i FROM q)
    """,
)
def itr2_iterations(t):
    return _looped(t, 2).iterations.select(
        "run_id",
        "iteration",
        F.size("code_blocks").cast("long").alias("n_blocks"),
        F.col("final_answer").isNotNull().alias("answered"),
    )


@query(
    "itr3_complete_or_direct",
    "WITH "
    + LOOP_SQL.format(limit=5)
    + """
    SELECT run_id, CASE WHEN run_id % 2 = 1 THEN 'DIRECT' ELSE kind END AS kind,
      CASE WHEN run_id % 2 = 1 THEN 'direct ' || length(text) ELSE answer END AS answer
    FROM done JOIN q USING (run_id)
    """,
)
def itr3(t):
    questions = _questions(t).withColumn("depth", F.col("run_id") % 2)

    def reply(prompt):
        return f"direct {len(prompt)}" if isinstance(prompt, str) else scripted_reply(prompt)

    return complete_or_direct(
        questions,
        max_depth=1,
        prompt="context_line",
        client=lambda: RuleClient(reply),
        step=counting_step,
        max_iterations=5,
    ).select("run_id", "kind", "answer")
