"""All queries of the library without its optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import ingest, quality, records, relational, search

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (search, quality, ingest, records, relational)


def queries() -> dict[str, Query]:
    return {f.__name__: f for m in _MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
