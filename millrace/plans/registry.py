"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import model_queries, scale_queries, table_queries
from . import queries as registered


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The modules add their queries to one table when they are imported."""
    assert model_queries and scale_queries and table_queries
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
