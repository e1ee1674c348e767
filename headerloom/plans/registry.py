"""All named queries: name to callable(spark, sf_dir), and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from headerloom.plans import arrivals, assembly, clustering, counters, exports, families, forming, headers, inspecting, listing, matches, multipart, reads, scores, selection, store, titles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (assembly, families, store, reads, selection, scores, listing, arrivals, forming, inspecting, counters, matches, clustering, headers, multipart, exports, titles):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
