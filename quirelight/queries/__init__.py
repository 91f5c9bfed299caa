"""Registered queries of the core operators over the test tables, with their SQL.

Each module of this folder holds a ``QUERIES`` table: name -> (function of session and table
folder, SQL or None where SQL cannot say it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelight.queries import coding, evidence, preparation, reports, texts, topics, vectors

_MODULES = (preparation, texts, vectors, topics, coding, evidence, reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, (_, s) in m.QUERIES.items() if s}
