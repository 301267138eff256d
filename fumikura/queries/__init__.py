"""Registered queries of the core operators, and the SQL that gives the same rows.

Each module has QUERIES (name -> function of session and folder) and SQL (name -> query for DuckDB).
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("corpus", "concordance", "stylometry", "vectors", "topics", "quality", "texts", "metadata", "streams")


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"fumikura.queries.{m}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
