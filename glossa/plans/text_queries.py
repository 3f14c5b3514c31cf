"""English planner, phrase terms, token counts, and the streamed visit counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import phrases
from glossa.functions import text as X
from glossa.operators import english, index
from glossa.session import shared_dir, table
from glossa.streaming import visits


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "search_documents").select("english_text").filter("english_text is not null").distinct()


def english_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every English text as a submitted query against the dictionary's terms."""
    queries = _texts(spark, sf).select(F.col("english_text").alias("query_id"), F.col("english_text").alias("query"))
    return english.plan(queries, index.entry_terms(table(spark, sf, "entries"), "id", "headword"))


def phrase_terms(spark: SparkSession, sf: str) -> DataFrame:
    heads = table(spark, sf, "entries").select("headword").filter("headword is not null").distinct()
    return heads.select("headword", F.posexplode(phrases.phrase_index_terms("headword")).alias("place", "term"))


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and places of every word of the English texts."""
    words = _texts(spark, sf).select("english_text", F.explode(X.planner_tokens(F.col("english_text"))).alias("word"))
    return words.groupBy("word", "english_text").agg(F.count("*").alias("n")).groupBy("word").agg(F.count("*").alias("texts"), F.sum("n").alias("places"))


def visit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Visits by entry from the history read as a stream to its end."""
    path = f"{sf}/history.parquet"  # read by pattern, for it is one file or a folder of files
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    base = f"{shared_dir(spark)}/visits-{uuid.uuid4().hex}"
    totals = visits.visit_totals(events, "entry_id", "visited_at")
    run = totals.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    query = run.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("entry_id", "visits", F.unix_micros("last_at").alias("last_at"))


QUERIES = {"english_plan": english_plan, "phrase_terms": phrase_terms, "word_counts": word_counts, "visit_stream": visit_stream}
ORACLE = {
    "word_counts": r"""WITH t AS (SELECT DISTINCT english_text FROM search_documents WHERE english_text IS NOT NULL),
        w AS (SELECT english_text, unnest(regexp_extract_all(translate(lower(trim(english_text)), '’', ''''), '[\pL\p{Nd}]+(?:[''-][\pL\p{Nd}]+)*')) AS word FROM t)
        SELECT word, count(DISTINCT english_text) AS texts, count(*) AS places FROM w GROUP BY 1""",
    "visit_stream": "SELECT entry_id, count(*) AS visits, epoch_us(max(visited_at)) AS last_at FROM history GROUP BY 1",
}
