"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import document_queries, event_queries, extra_queries, ingest_queries, json_queries, metric_queries, more_queries, relational_queries, retrieval_queries, scalar_queries, scoring_queries, search_queries, text_queries, trajectory_queries, vector_queries  # noqa: F401  they register
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "bm25_search"
