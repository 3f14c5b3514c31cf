"""All core queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.plans import analytics_queries, canonical_queries, judging_queries, lexical_queries, nested_queries, request_queries, reverse_queries, semantic_queries, text_queries

MODULES = (lexical_queries, reverse_queries, semantic_queries, analytics_queries, judging_queries, text_queries, nested_queries, request_queries, canonical_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
