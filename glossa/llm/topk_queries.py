"""Problem 2: the five heaviest documents of every entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm.topk import top_per_group
from glossa.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_per_group(table(spark, sf, "search_documents"), "entry_id", "weight", "id", 5).select("entry_id", "id")


QUERIES = {"p2_found": p2_found}
ORACLE = {
    "p2_found": """
        SELECT entry_id, id FROM (
          SELECT entry_id, id, row_number() OVER (PARTITION BY entry_id ORDER BY w DESC, id) AS rn
          FROM (SELECT entry_id, id, max(weight) AS w FROM search_documents
                WHERE entry_id IS NOT NULL AND weight IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2))
        WHERE rn <= 5"""
}
