"""All queries over the tables by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import clustering, dense, lexical, lifecycle, metrics, registry, relational, retrieval, structure, training  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query by name; it takes the session and the folder of the tables."""
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    """The SQL of each query that SQL can express."""
    return registry.oracle_sql()
