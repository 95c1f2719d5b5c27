"""A registry of queries: a function of (session, table reader) and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Table = Callable[[str], DataFrame]
_QUERIES: dict[str, Callable[[Table], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of a table reader under its name."""

    def register(f: Callable[[Table], DataFrame]) -> Callable[[Table], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query as a function of the session and the folder of the tables."""
    def bound(f: Callable[[Table], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..workspace import ship

            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        return run

    return {name: bound(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of each query that has one."""
    return dict(_SQL)
