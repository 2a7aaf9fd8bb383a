"""Queries by name, each with SQL for the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.sources.catalog import Catalog, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Registers f(catalog); ``tables`` are the logical tables that the SQL names."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[name] = with_tables(sql, *tables) if tables else sql
        return f

    return add
