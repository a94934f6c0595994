"""All registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import articles, catalog, comparisons


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog.queries() | comparisons.queries() | articles.queries()


def oracle_sql() -> dict[str, str]:
    return catalog.oracle_sql() | comparisons.oracle_sql() | articles.oracle_sql()
