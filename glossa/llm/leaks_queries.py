"""Problem 7: held-out passages inside the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.leaks import leaks
from glossa.session import table


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "holdout_passages"), "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items and the documents that hold them, by split and category of the item."""
    items = table(spark, sf, "holdout_passages").select("item_id", "split", "category").distinct()
    return _leaks(spark, sf).join(items, "item_id").groupBy("split", "category").agg(
        F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("share"), 6).alias("mean_share")
    )


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
ORACLE: dict[str, str] = {}
