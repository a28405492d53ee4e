"""All queries of this package but those of the llm subpackage."""

from __future__ import annotations

from . import cell_queries, design_queries, inference_queries, loading_queries, model_queries, protocol_queries, report_queries, trial_queries, vector_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
