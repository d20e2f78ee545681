"""Registered queries over the given tables, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.bindings import Tables

Body = Callable[[Tables], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.bodies: dict[str, Body] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Body], Body]:
        def add(body: Body) -> Body:
            if name in self.bodies:
                raise ValueError(f"query {name} is registered twice")
            self.bodies[name] = body
            if sql is not None:
                self.oracles[name] = sql
            return body
        return add

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(body: Body) -> Callable[[SparkSession, str], DataFrame]:
            return lambda spark, folder: body(Tables(spark, folder))
        return {name: bind(body) for name, body in self.bodies.items()}


registry = Registry()


def load() -> Registry:
    """Import every query module once; each registers itself."""
    from tallymark.queries import aggregates, controls, filters, functions, graph, joins, records, sources, tools  # noqa: F401
    return registry
