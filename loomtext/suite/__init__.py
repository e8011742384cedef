"""Registered queries. Importing this package fills the registry."""

from loomtext.suite import (  # noqa: F401
    asking_queries,
    context_queries,
    log_queries,
    stream_queries,
    usage_queries,
)
from loomtext.suite.registry import ORACLES, QUERIES, Tables, query

__all__ = ["ORACLES", "QUERIES", "Tables", "query"]
