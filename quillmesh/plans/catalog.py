"""All queries by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import extra_queries, more_queries, pdf_queries, relational_queries, stored_queries, stream_queries, text_queries, url_queries, vector_queries  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
