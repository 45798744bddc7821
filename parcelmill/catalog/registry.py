"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelmill.catalog.inputs import BASE_CTES, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_base(select: str, **ctes: str) -> str:
    """A query over the shared input relations, with further named steps."""
    steps = [*BASE_CTES.items(), *ctes.items()]
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in steps) + "\n" + select


def query(name: str, sql: str | None = None, **ctes: str):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` gives the same rows on DuckDB."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_base(sql, **ctes)
        return fn

    return register
