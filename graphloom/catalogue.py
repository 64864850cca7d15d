"""The queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from graphloom.plans import eval_queries, graph_queries, text_queries

QUERIES: dict = text_queries.QUERIES | graph_queries.QUERIES | eval_queries.QUERIES
ORACLES: dict = text_queries.ORACLES | graph_queries.ORACLES | eval_queries.ORACLES
