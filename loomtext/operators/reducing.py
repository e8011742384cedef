"""Ask about many chunks and reduce the answers: map-reduce, trees, sections, ordered folding.

Every round of answers is written before it is read, so no plan asks a model twice. Answers that do
not fit one prompt are reduced in budget-sized pieces, so no row grows with a context.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.messages import render_prompt
from loomtext.functions.text import whole_division
from loomtext.models import ClientFactory, EchoClient
from loomtext.operators.asking import Limits, answering, ask, errors_as_values
from loomtext.operators.chunking import chunk_by_header, section_position
from loomtext.operators.ordering import SLICE_ROWS, join_ordered, ordered_scan, row_number
from loomtext.operators.usage import UsageLedger
from loomtext.schema import USAGE
from loomtext.scratch import materialise, scratch_path
from loomtext.session import ship_package

# Default prompts; every operator takes its own instead.
CHUNK_PROMPT = "Question: {query}\n\nPart of the material:\n{chunk}\n\nSay what this part tells about it."
COMBINE_PROMPT = "Question: {query}\n\nFindings, part by part:\n{answers}\n\nGive one answer."
SECTION_PROMPT = "Section {header}:\n{body}\n\nState its main points."
SUMMARIES_PROMPT = "Question: {query}\n\nMain points by section:\n{answers}\n\nGive one answer."
STEP_PROMPT = (
    "Question: {query}\nNotes so far: {buffer}\n"
    "Section {section_no} of {n_sections}:\n{section}\n\nBring the notes up to date."
)
LAST_PROMPT = "Question: {query}\nNotes: {buffer}\nFinal section:\n{section}\n\nGive the answer."

#: The error of a key whose joined answers are as long as before.
NO_SHRINKING = "Answers do not shrink below the budget; raise it."

BUDGET = 500_000
#: What a written round keeps of its calls.
CALL_COLUMNS = ["root_model", "calls", "input_tokens", "output_tokens", "seconds", "error"]
#: Characters of sections that a folding task holds ahead of the calls.
HELD_CHARS = 64_000_000


def _answers(
    df: DataFrame, client: ClientFactory, options: dict, spread: bool = False
) -> DataFrame:
    """Ask, turn errors into text, and write the round.

    ``spread`` deals prompts that come out of a shuffle to as many tasks as the cluster has cores:
    they are few bytes and dear in time, so adaptive execution would put them into one task.
    """
    if spread:
        options = {"partitions": df.sparkSession.sparkContext.defaultParallelism, **options}
    asked = errors_as_values(ask(df, client, **options))
    kept = [c for c in df.columns if c != "prompt"]
    return materialise(asked.select(*kept, "answer", *CALL_COLUMNS), "answers")


def _with_keys(rows: DataFrame, chosen: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys that may be NULL."""
    other = chosen.select(*[F.col(k).alias(f"_other_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    return rows.join(other, same, how)


def reduce_answers(
    answers: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    template: str,
    query: Column | str,
    client: ClientFactory,
    budget: int = BUDGET,
    separator: str = "\n",
    slice_rows: int | None = SLICE_ROWS,
    ledger: UsageLedger | None = None,
    **options,
) -> DataFrame:
    """Join each key's ``answer`` texts in order and ask once more: (keys, answer, usage, seconds, n_errors).

    A key whose answers pass ``budget`` is asked about in pieces, and those answers are reduced in
    turn until one is left. A key whose answers do not get shorter ends with the error ``NO_SHRINKING``
    as its answer; the others go on. Usage is that of all rounds, with what ``ledger`` holds already.
    """
    keys, order = list(keys), list(order)
    ledger = UsageLedger(keys) if ledger is None else ledger
    finished, remaining, previous = None, answers, None
    while True:
        pieces = join_ordered(
            remaining, keys, order, "answer", separator, budget, slice_rows
        ).withColumn("prompt", render_prompt(template, query=query, answers=F.col("text")))
        asked = _answers(pieces.select(*keys, "piece_idx", "prompt"), client, options, spread=True)
        ledger.add(asked)
        if asked.where("piece_idx > 0").isEmpty():
            done = asked.select(*keys, "answer")
            return ledger.attach(done if finished is None else finished.unionByName(done))
        sizes = materialise(
            asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "sizes"
        )
        done = _with_keys(asked, sizes, keys, "left_anti").select(*keys, "answer")
        finished = done if finished is None else finished.unionByName(done)
        if previous is not None:
            before = previous.withColumnsRenamed({**{k: f"_was_{k}" for k in keys}, "_n": "_was"})
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_was_{k}")) for k in keys])
            stuck = materialise(
                sizes.join(before, same).where(F.col("_n") >= F.col("_was")).select(*keys), "stuck"
            )
            failed = F.lit(f"Error: {NO_SHRINKING}")
            finished = finished.unionByName(stuck.select(*keys, failed.alias("answer")))
            sizes = materialise(_with_keys(sizes, stuck, keys, "left_anti"), "sizes")
            if sizes.isEmpty():
                return ledger.attach(finished)
        previous = sizes
        remaining = _with_keys(asked, sizes, keys, "left_semi").withColumnRenamed("piece_idx", "_part")
        order = ["_part"]


def map_reduce_answer(
    chunks: DataFrame,
    query: Column | str,
    client: ClientFactory = EchoClient,
    keys: Sequence[str] = ("ctx_id",),
    order: Sequence[str] = ("chunk_idx",),
    chunk: str = "chunk",
    chunk_template: str = CHUNK_PROMPT,
    combine_template: str = COMBINE_PROMPT,
    budget: int = BUDGET,
    slice_rows: int | None = SLICE_ROWS,
    **options,
) -> DataFrame:
    """Ask about every chunk, join the answers in order, ask once more per key: (keys, answer, usage, seconds,
    n_errors), the usage being that of all calls made for the key."""
    prompts = chunks.select(
        *keys,
        *order,
        render_prompt(chunk_template, query=query, chunk=F.col(chunk)).alias("prompt"),
    )
    answers = _answers(prompts, client, options)
    ledger = UsageLedger(keys)
    ledger.add(answers)
    return reduce_answers(
        answers,
        keys,
        order,
        combine_template,
        query,
        client,
        budget,
        slice_rows=slice_rows,
        ledger=ledger,
        **options,
    )


def section_summaries(
    docs: DataFrame,
    query: Column | str,
    client: ClientFactory = EchoClient,
    key: str = "ctx_id",
    text: str = "text",
    section_template: str = SECTION_PROMPT,
    combine_template: str = SUMMARIES_PROMPT,
    budget: int = BUDGET,
    slice_rows: int | None = SLICE_ROWS,
    **options,
) -> DataFrame:
    """Summarise every Markdown section, join ``header: summary`` lines, ask once per text: (key, answer,
    usage, seconds, n_errors)."""
    sections = chunk_by_header(docs.select(key, text), text)
    prompts = sections.select(
        key, "section_idx", "header", render_prompt(section_template).alias("prompt")
    )
    summaries = _answers(prompts, client, options).withColumn(
        "answer", F.concat("header", F.lit(": "), "answer")
    )
    ledger = UsageLedger([key])
    ledger.add(summaries)
    return reduce_answers(
        summaries,
        [key],
        ["section_idx"],
        combine_template,
        query,
        client,
        budget,
        slice_rows=slice_rows,
        ledger=ledger,
        **options,
    )


def tree_reduce(
    parts: DataFrame,
    fan_in: int,
    max_depth: int,
    query: Column | str,
    client: ClientFactory = EchoClient,
    keys: Sequence[str] = ("ctx_id",),
    order: Sequence[str] = ("part_idx",),
    text: str = "text",
    template: str = COMBINE_PROMPT,
    budget: int = BUDGET,
    slice_rows: int | None = SLICE_ROWS,
    **options,
) -> DataFrame:
    """Reduce ``fan_in`` neighbours at a time until one answer per key is left: (keys, answer, depth, usage,
    seconds, n_errors).

    Neighbours whose joined texts pass ``budget`` are asked about in pieces, which are neighbours on the next
    level. Keys still holding several texts at ``max_depth`` are finished by one direct call over the rest.
    Each level is one shuffle over (key, group), where a group has at most ``fan_in`` rows.
    """
    keys = list(keys)
    ledger = UsageLedger(keys)
    numbered = ordered_scan(
        parts.select(*keys, *order, F.col(text).alias("answer")), keys, list(order), {"_rn": row_number()},
        slice_rows,
    )
    level = numbered.select(*keys, (F.col("_rn") - 1).alias("_idx"), "answer")
    finished = None
    for depth in range(1, max_depth + 1):
        # Windows and rows of at most ``fan_in`` texts; a row goes only as far as the budget.
        group = [*keys, "_group"]
        before = Window.partitionBy(*group).orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
        text_length = F.coalesce(F.length("answer"), F.lit(0)) + 1
        starts = F.coalesce(F.sum(text_length).over(before), F.lit(0))
        pieces = (
            level.withColumn("_group", whole_division(F.col("_idx"), fan_in))
            .withColumn("_piece", whole_division(starts, budget))
            .groupBy(*group, "_piece")
            .agg(F.array_sort(F.collect_list(F.struct("_idx", "answer"))).alias("_items"))
        )
        joined = F.array_join(F.transform("_items", lambda i: F.coalesce(i["answer"], F.lit(""))), "\n")
        prompts = pieces.select(
            *group, "_piece", render_prompt(template, query=query, answers=joined).alias("prompt")
        )
        asked = _answers(prompts, client, options, spread=True)
        ledger.add(asked)
        if asked.where("_group > 0 OR _piece > 0").isEmpty():
            done = asked.select(*keys, "answer", F.lit(depth).cast("long").alias("depth"))
            return ledger.attach(done if finished is None else finished.unionByName(done))
        open_keys = materialise(
            asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "open"
        )
        done = _with_keys(asked, open_keys, keys, "left_anti").select(
            *keys, "answer", F.lit(depth).cast("long").alias("depth")
        )
        finished = done if finished is None else finished.unionByName(done)
        rest = _with_keys(asked, open_keys, keys, "left_semi").select(*group, "_piece", "answer")
        if rest.where("_piece > 0").isEmpty():
            level = rest.select(*keys, F.col("_group").alias("_idx"), "answer")
        else:
            placed = ordered_scan(rest, keys, ["_group", "_piece"], {"_rn": row_number()}, slice_rows)
            level = placed.select(*keys, (F.col("_rn") - 1).alias("_idx"), "answer")
    direct = reduce_answers(
        level, keys, ["_idx"], template, query, client, budget, slice_rows=slice_rows, ledger=ledger, **options
    ).select(*keys, "answer", F.lit(max_depth + 1).cast("long").alias("depth"))
    return ledger.attach(direct if finished is None else finished.unionByName(direct))


def fold_sections(
    sections: DataFrame,
    query: str,
    client: ClientFactory = EchoClient,
    key: str = "ctx_id",
    order: Sequence[str] = ("part_idx",),
    text: str = "text",
    step_template: str = STEP_PROMPT,
    last_template: str = LAST_PROMPT,
    segment: int = 1000,
    slice_rows: int | None = SLICE_ROWS,
    model: str | None = None,
    concurrency: int = 8,
    limits: Limits = Limits(),
) -> DataFrame:
    """Refine a buffer section by section, in order: (key, n_sections, buffer, usage, seconds, n_errors).

    Each step needs the buffer of the one before, so a text's own sections go one after the other and
    texts go side by side, ``concurrency`` of them in a task. Sections are taken ``segment`` per text at a time:
    a round streams through that many, and writes the buffers, so a very long text neither fills a task nor
    loses more than a round when an executor dies. A task reads ahead of the calls as far as it has texts to
    start and ``HELD_CHARS`` allow. NULL is a text like any other.
    """
    spark = sections.sparkSession
    ship_package(spark)
    placed = section_position(
        sections.select(key, *order, F.coalesce(F.col(text), F.lit("")).alias("_section")),
        [key],
        list(order),
        slice_rows,
    ).select(
        F.col(key).alias("_key"),
        "section_no",
        "n_sections",
        "is_last",
        "_section",
        whole_division(F.col("section_no"), segment).cast("int").alias("_wave"),
    )
    path = scratch_path(spark, "sections")
    placed.write.partitionBy("_wave").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    waves = placed.agg(F.max("_wave")).first()[0]
    spent = ["calls", "input_tokens", "output_tokens", "seconds"]
    key_type = placed.schema["_key"].dataType.simpleString()
    state = (
        f"_key {key_type}, n_sections long, ended boolean, buffer string, calls long, input_tokens long, "
        "output_tokens long, seconds double, n_errors long"
    )
    names = [field.split()[0] for field in state.split(", ")]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        """The sorted rows of one text after another."""
        own: list[tuple] = []
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                if own and row[0] != own[0][0]:
                    yield own
                    own = []
                own.append(row)
        if own:
            yield own

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, held, done = {}, 0, []

        def prompt(run: Run) -> str:
            _, number, total, is_last, section, *_ = run.rows[run.at]
            template = last_template if is_last else step_template
            return template.format(
                section_no=number, n_sections=total, buffer=run.buffer, query=query, section=section
            )

        with answering(client(), concurrency, limits) as calls:

            def settle() -> None:
                nonlocal held
                place, row = calls.result()
                run = open_[place]
                run.take(row)
                if run.at < len(run.rows):
                    calls.submit(place, (prompt(run), model))
                    return
                del open_[place]
                held -= run.size
                last = run.rows[-1]
                done.append((last[0], last[2], bool(last[3]), run.buffer, *run.spent, run.errors))

            for place, rows in enumerate(runs(batches)):
                run = open_[place] = Run(rows)
                held += run.size
                calls.submit(place, (prompt(run), model))
                while open_ and (len(open_) >= concurrency or held > HELD_CHARS):
                    settle()
                if len(done) >= 1000:
                    yield pd.DataFrame(done, columns=names)
                    done = []
            while open_:
                settle()
        yield pd.DataFrame(done, columns=names)

    columns = ["_key", "section_no", "n_sections", "is_last", "_section"]
    carried = ["buffer", *spent, "n_errors"]
    held, finished = None, None
    for wave in range((waves if waves is not None else -1) + 1):
        rows = placed.where(F.col("_wave") == wave).select(*columns)
        if held is None:
            kinds = dict(spark.createDataFrame([], state).dtypes)
            rows = rows.select("*", *(F.lit(None).cast(kinds[c]).alias(f"_{c}") for c in carried))
        else:
            before = held.select(F.col("_key").alias("_before"), *(F.col(c).alias(f"_{c}") for c in carried))
            rows = rows.join(before, F.col("_key").eqNullSafe(F.col("_before")), "left").drop("_before")
        # A stated number is kept, where adaptive execution would serve all texts in one task.
        tasks = spark.sparkContext.defaultParallelism
        ordered = rows.repartition(tasks, "_key").sortWithinPartitions("_key", "section_no")
        held = materialise(ordered.mapInPandas(fold, state), "buffers")
        ended = held.where("ended")
        finished = ended if finished is None else finished.unionByName(ended)
        held = held.where("NOT ended")
    if finished is None:
        finished = spark.createDataFrame([], state)
    total = F.struct(*(F.col(c) for c in spent[:3])).cast(USAGE)
    usage = F.create_map(F.lit(model or "unknown"), total)
    return finished.select(
        F.col("_key").alias(key), "n_sections", "buffer", usage.alias("usage"), "seconds", "n_errors"
    )


class Run:
    """The sections of one text that a fold goes through, with its notes and what they have cost so far."""

    def __init__(self, rows: list[tuple]):
        buffer, *spent, errors = rows[0][5:]
        self.rows, self.at = rows, 0
        self.size = sum(len(row[4]) for row in rows)
        self.buffer, self.errors = buffer or "", int(errors or 0)
        self.spent = [None if x is None else x for x in spent]

    def take(self, row: tuple) -> None:
        """Note the answer row of the call for the present section."""
        _, response, error, *spent = row
        self.buffer = response if error is None else f"Error: {error}"
        self.errors += error is not None
        self.spent = [a if b is None else b + (a or 0) for a, b in zip(self.spent, spent, strict=True)]
        self.at += 1
