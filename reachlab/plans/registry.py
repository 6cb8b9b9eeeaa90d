"""Query registry: name -> (Spark callable, optional DuckDB oracle SQL).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
of the given tables. Queries are grouped by area in the ``*_queries`` modules,
which register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from reachlab.plans import (  # noqa: F401  (imports register the queries)
        prep_queries,
        profile_queries,
        eval_queries,
        split_queries,
        model_queries,
        explain_queries,
        tune_queries,
        invariant_queries,
    )
