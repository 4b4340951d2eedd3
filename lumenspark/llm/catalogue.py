"""The registry of this subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm import queries_a, queries_b, queries_c, queries_d, queries_e

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (queries_a, queries_b, queries_c, queries_d, queries_e):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
