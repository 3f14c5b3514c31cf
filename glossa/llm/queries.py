"""All queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import forms_queries, leaks_queries, neighbours_queries, overlap_queries, packing_queries, topics_queries, topk_queries

MODULES = (overlap_queries, topk_queries, neighbours_queries, forms_queries, packing_queries, leaks_queries, topics_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
