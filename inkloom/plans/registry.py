"""Every query of the core by name, and its SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_books, queries_library, queries_reading, queries_retrieval, queries_text, queries_vectors, queries_versions

MODULES = (queries_books, queries_library, queries_reading, queries_retrieval, queries_text, queries_vectors, queries_versions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.SQL
    return out
