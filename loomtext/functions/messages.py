"""Message columns: ARRAY<STRUCT<role, content>>."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import truncate_text

MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"


# Wording of the messages a model sees.
FIRST_TURN = "You have not interacted with the REPL environment or seen your prompt / context yet. Your next action should be to look through and figure out how to answer the prompt, so don't just provide a final answer yet.\n\n"
LATER_TURN = "The history before is your previous interactions with the REPL environment. "
GENERAL_PROMPT = "Think step-by-step on what to do using the REPL environment (which contains the context) to answer the prompt.\n\nContinue using the REPL environment, which has the `context` variable, and querying sub-LLMs by writing to ```repl``` tags, and determine your answer. Your next action:"
QUESTION_PROMPT = 'Think step-by-step on what to do using the REPL environment (which contains the context) to answer the original prompt: "{question}".\n\nContinue using the REPL environment, which has the `context` variable, and querying sub-LLMs by writing to ```repl``` tags, and determine your answer. Your next action:'
CLOSING_PROMPT = "Please provide a final answer to the user's question based on the information provided."
EXECUTION_MESSAGE = "Code executed:\n```python\n{code}\n```\n\nREPL output:\n{output}"
NO_OUTPUT = "No output"


def render_prompt(template: str, **values: Column | str) -> Column:
    """Fill ``{name}`` places of a template from columns; plain strings are literals, not columns."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = values[name] if name in values else F.col(name)
            value = F.lit(value) if isinstance(value, str) else value
            parts.append(F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*parts)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(text: Column) -> Column:
    """A plain text as a list of one user message."""
    return F.array(message("user", text))


def is_simple_value(value: Column) -> Column:
    """True for VARIANT values a reader would want to see: text, numbers, flags, lists, objects.

    Logs hold modules and functions as ``<module 'm'>`` text; the pattern is closed, so that other
    text starting with ``<`` stays.
    """
    return value.isNotNull() & ~F.is_variant_null(value) & ~is_opaque_text(_text_of(value))


def _text_of(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def is_opaque_text(text: Column) -> Column:
    return text.rlike(r"(?s)\A<(module|function|type|method|builtin_function_or_method) '.*'>\z")


def visible_names(variables: Column) -> Column:
    """Names of the user's variables in assignment order, from a MAP<STRING, VARIANT>."""
    kept = F.map_filter(
        variables, lambda name, value: ~F.startswith(name, F.lit("_")) & is_simple_value(value)
    )
    return F.map_keys(kept)


def render_execution(stdout: Column, stderr: Column, names: Column) -> Column:
    """Text of an execution result as the next prompt shows it."""
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    listing = F.when(
        F.size(names) > 0, F.concat(F.lit("REPL variables: ["), quoted, F.lit("]\n"))
    )
    parts = F.array_compact(
        F.array(
            F.when(stdout != "", F.concat(F.lit("\n"), stdout)),
            F.when(stderr != "", F.concat(F.lit("\n"), stderr)),
            listing,
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(NO_OUTPUT)


def execution_message(code: Column, rendered: Column, limit: int = 20_000) -> Column:
    """The user message that shows a code block and its (cut) output to the model."""
    shown = truncate_text(rendered, limit, "counted")
    return message("user", render_prompt(EXECUTION_MESSAGE, code=code, output=shown))


def iteration_messages(response: Column, blocks: Column, limit: int = 20_000) -> Column:
    """Messages an iteration adds to the history: the response, then one message per code block."""

    def shown(block: Column) -> Column:
        result = block["result"]
        names = F.coalesce(visible_names(result["locals"]), F.array().cast("array<string>"))
        rendered = render_execution(result["stdout"], result["stderr"], names)
        return execution_message(block["code"], rendered, limit)

    answer = F.array(message("assistant", response))
    shown_blocks = F.coalesce(F.transform(blocks, shown), F.array().cast(MESSAGES))
    return F.concat(answer, shown_blocks)


def turn_prompt(turn: Column, question: Column) -> Column:
    """User message of a turn (0-based); a NULL or empty question gives the general wording."""
    asked = F.when(
        F.coalesce(question, F.lit("")) != "", render_prompt(QUESTION_PROMPT, question=question)
    ).otherwise(GENERAL_PROMPT)
    return F.concat(F.when(turn == 0, FIRST_TURN).otherwise(LATER_TURN), asked)
