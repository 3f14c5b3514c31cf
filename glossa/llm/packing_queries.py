"""Problem 6: the corpus as training sequences of 1,024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.packing import Capacity, limits, pack, public_tokenizer, token_counts
from glossa.session import table


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    sizes = token_counts(table(spark, sf, "documents"), "doc_id", "text", public_tokenizer())
    return pack(sizes).withColumnRenamed("id", "doc_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of space that is used, beside the least number of containers that could hold the tokens, and how many containers each capacity limits."""
    by = limits(p6_pack(spark, sf).withColumnRenamed("doc_id", "id"))
    cap = Capacity().tokens
    named = lambda k: F.sum((F.col("limit") == k).cast("long")).alias(f"limited_by_{k}")
    return by.agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("pieces").alias("most_pieces"),
        F.ceil(F.sum("tokens") / cap).alias("least_containers"), F.round(F.sum("tokens") / F.count("*") / cap, 6).alias("used"), named("tokens"), named("documents"), named("cost"),
    )


QUERIES = {"p6_pack": p6_pack, "p6_report": p6_report}
ORACLE: dict[str, str] = {}
