"""A module's queries: ``@queries.add(name, sql)`` keeps a query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    def __init__(self) -> None:
        self.run: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.run[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
