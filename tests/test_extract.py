"""Code blocks, final answers, text functions; the quirks that SQL checks leave out."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions.extract import code_blocks, final_answer
from loomtext.functions.messages import (
    iteration_messages,
    render_execution,
    turn_prompt,
    visible_names,
)
from loomtext.functions.text import (
    estimated_tokens,
    message_characters,
    strip_blanks,
    truncate_text,
    word_count,
)
from loomtext.schema import BLOCK


def value(spark, column, **cells):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, blocks",
    [
        ("Here's some code:\n```repl\nx = 1 + 2\nprint(x)\n```\nDone.", ["x = 1 + 2\nprint(x)"]),
        ("First:\n```repl\na = 1\n```\nSecond:\n```repl\nb = 2\n```\nEnd.", ["a = 1", "b = 2"]),
        ("Just plain text without any code blocks.", []),
        ("```python\nx = 1\n```\n```repl\ny = 2\n```\n", ["y = 2"]),
        (
            "```repl\ndef f(n):\n    if n:\n        return 1\n\n    return 2\n```",
            ["def f(n):\n    if n:\n        return 1\n\n    return 2"],
        ),
        ("```repl \u2003\n\x1c  z = 1 \x1f\u00a0\n```", ["z = 1"]),
        ("```repl\n```", []),
        ("```repl\n\n```", [""]),
    ],
)
def test_code_blocks(spark, text, blocks):
    assert value(spark, code_blocks(F.col("t")), t=text) == blocks


@pytest.mark.parametrize(
    "text, answer",
    [
        ("The answer is:\nFINAL(42)", ("FINAL", "42")),
        ("Check the variable:\nFINAL_VAR(result)", ("FINAL_VAR", "result")),
        ("Still working on the problem...", None),
        ("FINAL(This is a\nmultiline answer)", ("FINAL", "This is a\nmultiline answer")),
        ("The result is FINAL(42)", None),
        ("   FINAL(answer with spaces)", ("FINAL", "answer with spaces")),
        ("FINAL(f(a))", ("FINAL", "f(a")),
        ("FINAL(a)\nFINAL_VAR(b)", ("FINAL_VAR", "b")),
        ("a\rFINAL(1)", None),
        ("a\u2028FINAL(1)", None),
        ("\u2003FINAL( 1 )", ("FINAL", "1")),
        ("FINAL()", ("FINAL", "")),
        ("FINAL(open", None),
    ],
)
def test_final_answer(spark, text, answer):
    found = value(spark, final_answer(F.col("t")), t=text)
    assert (tuple(found) if found else None) == answer


def test_truncation(spark):
    cut = value(spark, truncate_text(F.col("t"), 5, "counted"), t="x" * 12)
    assert cut == "xxxxx... + [7 chars...]"
    assert value(spark, truncate_text(F.col("t"), 5), t="abcde") == "abcde"
    assert value(spark, truncate_text(F.col("t"), 3), t="a😀bcd") == "a😀b..."
    noted = value(spark, truncate_text(F.col("t"), style="noted"), t="y" * 8001)
    assert noted == "y" * 8000 + "\n\n... [content truncated for display]"


@pytest.mark.parametrize("characters, tokens", [(0, 0), (1, 0), (2, 1), (5, 1), (6, 2), (10, 3)])
def test_tokens_round_half_up(spark, characters, tokens):
    assert value(spark, estimated_tokens(F.col("t")), t="x" * characters) == tokens


def test_text_helpers(spark):
    assert value(spark, strip_blanks(F.col("t")), t="\x1c a b\u3000\n") == "a b"
    assert value(spark, word_count(F.col("t")), t="  a b\n\nc\u00a0d ") == 4
    messages = F.array(
        F.struct(F.lit("user").alias("role"), F.lit("abc").alias("content")),
        F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content")),
    )
    assert value(spark, message_characters(messages)) == 3


def rendered(spark, stdout="", stderr="", variables="{}"):
    names = visible_names(F.from_json(F.col("v"), "map<string,variant>"))
    shown = render_execution(F.col("o"), F.col("e"), names)
    return value(spark, shown, o=stdout, e=stderr, v=variables)


def test_rendering(spark):
    assert rendered(spark) == "No output"
    assert rendered(spark, "Hello") == "\nHello"
    assert rendered(spark, "a", "b") == "\na\n\n\nb"
    assert rendered(spark, variables='{"x": 42, "name": "t"}') == "REPL variables: ['x', 'name']\n"
    hidden = '{"_p": 1, "n": null, "m": "<module \'os\'>", "f": "<function \'f\'>"}'
    assert rendered(spark, variables=hidden) == "No output"
    kept = '{"z": [1], "a": {"b": 2}, "h": "<b>bold</b>", "t": true}'
    assert rendered(spark, variables=kept) == "REPL variables: ['z', 'a', 'h', 't']\n"


def test_iteration_messages(spark):
    block = F.from_json(
        F.lit('[{"code":"print(1)","result":{"stdout":"' + "x" * 300 + '","stderr":"","locals":{}}}]'),
        f"array<{BLOCK}>",
    )
    added = value(spark, iteration_messages(F.lit("thinking"), block, 100))
    assert [m["role"] for m in added] == ["assistant", "user"]
    start = "Code executed:\n```python\nprint(1)\n```\n\nREPL output:\n\n"
    assert added[1]["content"] == start + "x" * 99 + "... + [201 chars...]"
    alone = value(spark, iteration_messages(F.lit("idea"), F.array().cast(f"array<{BLOCK}>")))
    assert len(alone) == 1


def test_turn_prompt(spark):
    first = value(spark, turn_prompt(F.lit(0), F.lit("Why?")))
    assert first.startswith("You have not interacted") and 'original prompt: "Why?"' in first
    later = value(spark, turn_prompt(F.lit(3), F.lit("")))
    assert later.startswith("The history before") and "to answer the prompt.\n\n" in later
