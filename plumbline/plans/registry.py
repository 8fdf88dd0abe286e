"""Named queries over the test tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import lifecycle_queries, metric_queries, question_queries, reply_sql

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = [metric_queries, question_queries, lifecycle_queries]


def queries() -> dict[str, Query]:
    """All core queries by name."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the core queries by name."""
    return {name: sql for module in [*_MODULES, reply_sql] for name, sql in module.ORACLE_SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query over one folder of tables."""
    return metric_queries.debias_grid(spark, folder)
