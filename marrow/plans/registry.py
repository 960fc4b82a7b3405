"""Registry of named queries: a Spark builder and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, operators: tuple[str, ...] = ()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None, operators)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens on import)."""
    from marrow.plans import (  # noqa: F401
        q_clean, q_stats, q_votes, q_sampling, q_encode, q_evaluate, q_tree, q_language,
        q_rowsonly, q_sinks, q_sources,
    )
    return REGISTRY
