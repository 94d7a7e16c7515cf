"""All registered queries of the relational engine and its function families, each with SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extensions, relational, streams, surface

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (relational, extensions, streams, surface):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
