"""The registry of queries on the driver tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenspark.plans import analytics, composite, planning, ranking, results, scalars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (ranking, scalars, analytics, planning, composite, results):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
