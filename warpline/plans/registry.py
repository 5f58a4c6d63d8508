"""A registry of named queries over a data folder, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warpline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, *tables: str, sql: str | None = None):
        """Register a function of the named tables."""

        def register(build):
            if name in self.queries:
                raise ValueError(f"the query {name} is registered twice")
            self.queries[name] = lambda spark, folder: build(*[table(spark, folder, t) for t in tables])
            if sql is not None:
                self.sql[name] = sql
            return build

        return register
