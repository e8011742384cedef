"""All queries of this subpackage. Importing this module fills the registry."""

from loomtext.llm import document_queries, page_queries, vector_queries  # noqa: F401
from loomtext.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
