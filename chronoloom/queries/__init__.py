"""Named queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def everything() -> tuple[dict[str, Query], dict[str, str]]:
    from . import activity, concepts, extras, plans, retrieval, sources, text, timeline, trees

    parts = [text.registry, timeline.registry, concepts.registry, trees.registry, activity.registry, retrieval.registry, sources.registry, plans.registry, extras.registry]
    found: tuple[dict[str, Query], dict[str, str]] = ({}, {})
    for p in parts:
        found[0].update(p.queries)
        found[1].update(p.sql)
    return found
