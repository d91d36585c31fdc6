"""All queries of the reference's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a05_report"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from pagewright.plans import diffs, layouts, sources, texts  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
