"""The queries of this subpackage and their SQL, kept apart from the library's own registry."""

from __future__ import annotations

from collections.abc import Callable

from loomtext.suite.registry import QueryFunction

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a query of this subpackage, with its SQL where SQL can express it."""

    def register(function: QueryFunction) -> QueryFunction:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register
