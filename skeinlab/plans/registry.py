"""A module's queries with their SQL."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.found: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def keep(f):
            self.found[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep

    def queries(self) -> dict:
        return dict(self.found)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
