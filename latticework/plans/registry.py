"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if f.__name__ in self.queries:
                raise ValueError(f"{f.__name__} is registered twice")
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put

    def add(self, name: str, f: Query, sql: str | None = None) -> None:
        f.__name__ = name
        self(sql)(f)
