"""Registered queries over the driver's tables, each with its DuckDB form where one exists."""

from __future__ import annotations

from tidemark.plans import drift_queries, model_queries, text_queries

QUERIES = {**text_queries.Q.queries, **drift_queries.Q.queries, **model_queries.Q.queries}
ORACLES = {**text_queries.Q.oracles, **drift_queries.Q.oracles, **model_queries.Q.oracles}
