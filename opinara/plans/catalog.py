"""All queries of the review engine and their DuckDB SQL."""

from __future__ import annotations

from . import evaluation_queries, interaction_queries, model_queries, source_queries, text_queries  # noqa: F401  (they register)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
