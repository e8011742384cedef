"""Pull code blocks and final answers out of model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import BLANK, strip_blanks

# The response format a root model is told to write.
CODE_BLOCK = rf"(?sU)```repl{BLANK}*\n(.*?)\n```"
# (?d) makes only \n a line end, so that no answer starts after \r or U+2028.
FINAL_VARIABLE = rf"(?smdU)^{BLANK}*FINAL_VAR\((.*?)\)"
FINAL_TEXT = rf"(?smdU)^{BLANK}*FINAL\((.*?)\)"


def code_blocks(response: Column) -> Column:
    """Bodies of the fenced ``repl`` blocks in order, trimmed; an empty array when there are none."""
    bodies = F.regexp_extract_all(response, F.lit(CODE_BLOCK), F.lit(1))
    return F.transform(bodies, strip_blanks)


def _answer(response: Column, opening: str, pattern: str) -> Column:
    """Content of the first match or NULL. The cheap substring test spares most rows the regex."""
    matched = F.when(F.contains(response, F.lit(opening)), F.regexp_extract(response, pattern, 0))
    return F.when(matched != "", strip_blanks(F.regexp_extract(matched, pattern, 1)))


def final_variable(response: Column) -> Column:
    return _answer(response, "FINAL_VAR(", FINAL_VARIABLE)


def final_text(response: Column) -> Column:
    return _answer(response, "FINAL(", FINAL_TEXT)


def final_answer(response: Column) -> Column:
    """STRUCT<kind, content>, or NULL. A variable answer wins over a plain one wherever each stands.

    The content ends at the first closing bracket, so ``FINAL(f(a))`` gives ``f(a``.
    """
    variable, text = final_variable(response), final_text(response)

    def pair(kind: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), content.alias("content"))

    return F.when(variable.isNotNull(), pair("FINAL_VAR", variable)).when(
        text.isNotNull(), pair("FINAL", text)
    )
