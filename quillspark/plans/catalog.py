"""Named queries over the supplied tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import context_queries, record_queries, rollup_queries, scan_queries, source_queries, stream_queries, text_queries, unit_queries

MODULES = (text_queries, record_queries, scan_queries, unit_queries, rollup_queries, context_queries, source_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
