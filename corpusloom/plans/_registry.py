"""A registry of queries with their SQL; one per module of queries."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, query: Callable, sql: str | None = None) -> None:
        assert name not in self.queries, name
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql
