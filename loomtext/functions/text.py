"""Text columns: stripping, truncation, size and token estimates. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that Python's str.strip removes. Java's Unicode \s lacks U+001C to U+001F.
BLANK = r"[\s\x1c-\x1f]"

# How each truncation style marks a cut, with its limit.
CUT_STYLES = {
    "counted": (20_000, "... + [{cut} chars...]"),
    "noted": (8_000, "\n\n... [content truncated for display]"),
    "dotted": (200, "..."),
}


def whole_division(number: Column, by: Column | int) -> Column:
    """Integer quotient as BIGINT, exact where a quotient of doubles is not."""
    return F.call_function("div", number, by if isinstance(by, Column) else F.lit(by))


def strip_blanks(text: Column) -> Column:
    """Remove leading and trailing Unicode blanks."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def strip_characters(text: Column, characters: str) -> Column:
    """Remove any of ``characters`` from both ends."""
    return F.btrim(text, F.lit(characters))


def truncate_text(text: Column, limit: int | None = None, style: str = "dotted") -> Column:
    """Keep the first ``limit`` characters and say that the rest was cut."""
    default, mark = CUT_STYLES[style]
    limit = default if limit is None else limit
    before, found, after = mark.partition("{cut}")
    cut = F.lit(before)
    if found:
        cut = F.concat(cut, (F.length(text) - F.lit(limit)).cast("string"), F.lit(after))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), cut)).otherwise(text)


def tokens_of_length(characters: Column) -> Column:
    """A quarter of the characters, halves rounded up, in whole numbers."""
    return whole_division(characters + F.lit(2), 4)


def estimated_tokens(text: Column) -> Column:
    return tokens_of_length(F.length(text))


def message_characters(messages: Column) -> Column:
    """Characters of all message contents joined with nothing between."""
    lengths = F.transform(messages, lambda m: F.coalesce(F.length(m["content"]), F.lit(0)))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)


def word_count(text: Column) -> Column:
    """Words separated by blanks."""
    words = F.split(text, rf"(?U){BLANK}+", -1)
    return F.size(F.filter(words, lambda w: w != "")).cast("long")
