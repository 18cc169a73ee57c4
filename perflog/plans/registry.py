"""Registry of named queries: a Spark builder plus, when SQL can say the same
thing, the DuckDB oracle text the driver checks it against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: QueryFn
    sql: str | None          # None: not SQL-expressible; checked by rows + fixture tests
    area: str                # SURVEY section letter(s)


REGISTRY: dict[str, Query] = {}


def register(name: str, area: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, area)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # import for side effect: each module registers its queries
    from perflog.plans import (q_windows, q_scalars, q_aggregates, q_lookups,  # noqa: F401
                               q_store, q_models, q_ml, q_player, q_pipelines, q_landing)
    return REGISTRY
