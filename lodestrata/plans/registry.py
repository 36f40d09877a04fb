"""One registry of queries, so that names, callables and checks cannot drift apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None = None


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(run: Query) -> Query:
            if name in self.entries:
                raise ValueError(f"two queries are called {name}")
            self.entries[name] = Entry(name, run, sql)
            return run

        return add

    def queries(self) -> dict[str, Query]:
        return {e.name: e.run for e in self.entries.values()}

    def oracles(self) -> dict[str, str]:
        return {e.name: e.sql for e in self.entries.values() if e.sql}
