"""The core queries by name, and their SQL."""

from __future__ import annotations

from . import activity_queries, balance_queries, dedup_queries, literal_queries, text_queries

_PARTS = (text_queries, dedup_queries, balance_queries, activity_queries, literal_queries)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL: dict = {k: f for p in _PARTS for k, f in p.SQL.items()}
