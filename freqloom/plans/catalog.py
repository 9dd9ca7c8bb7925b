"""Registry of queries: a name, a Spark function of (spark, sf_dir) and, where there is one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function as a query; sql is what DuckDB must answer alike."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from . import curation_queries, index_queries, mechanism_queries, search_queries, storage_queries, string_queries, study_queries, vector_queries  # noqa: F401


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temporary views of the named tables, for spark.sql()."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
