"""Problem 8: subject areas of the documents and their shares of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.topics import subjects_of, topic_report
from glossa.session import stored, table


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects_of(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "subject")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each subject and their share of all documents with a text."""
    docs = table(spark, sf, "documents")
    found = stored(subjects_of(docs, "doc_id", "text"), "subjects")
    total = docs.filter("length(text) > 0").agg(F.countDistinct("doc_id").alias("total"))
    by = found.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))
    return by.crossJoin(F.broadcast(total)).select("subject", "documents", "mean_share", F.round(F.col("documents") / F.col("total"), 6).alias("corpus_share"))


def p8_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted topics by their first terms, and the subject that each was given."""
    found = topic_report(table(spark, sf, "documents"), "doc_id", "text")
    return found.select("topic", "subject", "place", "term", F.round("weight", 6).alias("weight"))


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares, "p8_topics": p8_topics}
ORACLE: dict[str, str] = {}
