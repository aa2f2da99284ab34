"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where the operator is SQL-expressible, its DuckDB twin (``None`` otherwise).

Query modules call ``register`` at import time; ``__spark_entry__`` exposes the
result.  Column names of the two sides are identical by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from wattle.plans import (  # noqa: F401
        q_ledger, q_addresses, q_spatial, q_schools, q_quality, q_usage, q_loads,
    )
