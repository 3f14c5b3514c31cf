"""Problem 5: the documents in article payloads as tables of blocks, runs, marks and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import nested
from glossa.session import table

RUN = "blocks[].runs[]"
ARTICLE = nested.Shape(frozenset({"blocks", "blocks[].runs", f"{RUN}.marks"}), "blocks", ("blocks",))


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    return nested.shred(table(spark, sf, "etymology_articles"), "id", "payload", ARTICLE)


def _runs(triples: DataFrame) -> DataFrame:
    fields = {"text": "text", "target_term": "link.targetTerm", "target_article_id": "link.targetArticleId", "link": "link"}
    return nested.table(triples, RUN, ["block_no", "run_no"], fields, own="plain").filter("kind in ('object', 'string')")


def _marks(triples: DataFrame) -> DataFrame:
    return nested.table(triples, f"{RUN}.marks[]", ["block_no", "run_no", "mark_no"], {}, own="mark").filter("mark is not null")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    wanted = nested.Shape(ARTICLE.repeated, ARTICLE.anchor, (RUN,))
    triples = nested.shred(table(spark, sf, "etymology_articles"), "id", "payload", wanted).filter(F.col("path").isin(RUN, f"{RUN}.marks[]"))
    runs = nested.table(triples, RUN, ["block_no", "run_no"], {}).filter("kind in ('object', 'string')").drop("kind")
    rows = runs.join(_marks(triples), ["record", "block_no", "run_no"], "left")
    return rows.select(
        F.col("record").alias("article_id"), "block_no", "run_no", F.coalesce("mark_no", F.lit(-1)).alias("mark_no"), F.coalesce("mark", F.lit("")).alias("mark")
    )


def p5_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = nested.table(_triples(spark, sf), "blocks[]", ["block_no"], {"block_kind": "kind", "cite_work": "cite.work", "cite_year": "cite.year"}, own="plain")
    return rows.withColumnRenamed("record", "article_id")


def p5_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(_triples(spark, sf))
    return rows.select(F.col("record").alias("article_id"), "block_no", "run_no", F.coalesce("text", "plain").alias("text"))


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(_triples(spark, sf)).filter("target_term is not null or target_article_id is not null")
    return rows.select(F.col("record").alias("article_id"), "block_no", "run_no", "target_term", "target_article_id")


def nested_shape(spark: SparkSession, sf: str) -> DataFrame:
    return nested.paths_of(nested.shred(table(spark, sf, "etymology_articles"), "id", "payload", nested.Shape()))


QUERIES = {"p5_found": p5_found, "p5_blocks": p5_blocks, "p5_runs": p5_runs, "p5_links": p5_links, "nested_shape": nested_shape}
ORACLE: dict[str, str] = {}
