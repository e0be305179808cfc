"""Named queries: a function of the tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, make: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Add a query; ``sql`` may use the derived tables of ``sources.tables`` by name."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = with_tables(sql)
