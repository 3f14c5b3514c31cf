"""Problem 3: the five most similar texts of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.neighbours import blocks_to_vectors, neighbours
from glossa.session import table

WIDTH = 64
#: Lists that a search for the nearest visits: so many, and at more lists the share of them that gave a recall of 0.92 at 1,333.
VISITS, SHARE = 128, 128 / 1333


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return blocks_to_vectors(table(spark, sf, "vector_blocks"), "first_vector_id", "vector_count", "data", WIDTH)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbours(_vectors(spark, sf), 5, least=0.9)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, against all vectors, whatever their similarity."""
    found = neighbours(_vectors(spark, sf), 5, queries=F.col("id") % 50 == 0, visits=(VISITS, 2.0), share=SHARE)
    return found.select("id", "neighbour", F.round("cosine", 6).alias("cosine"))


QUERIES = {"p3_found": p3_found, "p3_knn": p3_knn}
ORACLE: dict[str, str] = {}
