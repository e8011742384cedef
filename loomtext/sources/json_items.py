"""The items of JSON lists and dicts, one after another, from texts of any length.

Only one item is decoded at a time, so a list of any number of items takes the memory of its text and its
largest item.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

BLANK = re.compile(r"[ \t\n\r]*")
#: A string, kept, or blanks outside of strings.
STRING_OR_BLANK = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\n\r]+')


class NotJson(ValueError):
    """The text is no JSON, with what is wrong and where."""


def _refuse(name: str):
    raise NotJson(f"{name} is no JSON value")


_decode = json.JSONDecoder(parse_constant=_refuse).raw_decode


def _after_blanks(text: str, at: int) -> int:
    return BLANK.match(text, at).end()


def _value(text: str, at: int) -> tuple[object, int]:
    try:
        return _decode(text, at)
    except json.JSONDecodeError as error:
        raise NotJson(f"{error.msg} at character {error.pos}") from None
    except RecursionError:
        raise NotJson(f"nested too deep at character {at}") from None


def opens_json(text: str) -> str:
    """``[`` or ``{`` if that is how the text starts after blanks, else empty."""
    return text[at] if (at := _after_blanks(text, 0)) < len(text) and text[at] in "[{" else ""


def items(text: str) -> Iterator[tuple[str | None, object, str]]:
    """(key, value, source) of every item in order, key NULL in lists. A key may come more than once.

    Raises NotJson where the text is neither a list nor a dict, or breaks off, goes on after its end, or
    holds no JSON.
    """
    at = _after_blanks(text, 0)
    opened = text[at : at + 1]
    if opened not in ("[", "{") or not opened:
        raise NotJson(f"neither a list nor a dict at character {at}")
    closing, at = "]" if opened == "[" else "}", _after_blanks(text, at + 1)
    more = text[at : at + 1] != closing
    while more:
        key = None
        if opened == "{":
            if text[at : at + 1] != '"':
                raise NotJson(f"no key at character {at}")
            key, at = _value(text, at)
            at = _after_blanks(text, at)
            if text[at : at + 1] != ":":
                raise NotJson(f"no colon at character {at}")
            at = _after_blanks(text, at + 1)
        value, end = _value(text, at)
        yield key, value, text[at:end]
        at = _after_blanks(text, end)
        following = text[at : at + 1]
        if following not in (",", closing) or not following:
            raise NotJson(f"neither a comma nor an end at character {at}")
        more = following == ","
        if more:
            at = _after_blanks(text, at + 1)
    at = _after_blanks(text, at + 1)
    if at < len(text):
        raise NotJson(f"more text at character {at}")


def as_text(value: object, source: str) -> str:
    """A string itself, an empty text for null, anything else in its JSON form without blanks."""
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    return STRING_OR_BLANK.sub(r"\1", source)


def field(source: str, name: str) -> str:
    """The text of the last field of that name in a JSON dict; empty where there is none."""
    found = ""
    for key, value, part in items(source):
        if key == name:
            found = as_text(value, part)
    return found
