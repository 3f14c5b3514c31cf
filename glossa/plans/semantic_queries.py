"""Vector search over the embeddings and the texts' vectors, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import numpy as np
import pandas as pd

from glossa.functions import text as X
from glossa.operators import evaluate, reverse, vectors
from glossa.plans.reverse_queries import _docs, _queries
from glossa.session import table


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id is not null and embedding is not null")


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), vectors.usable(v).alias("usable"))


def _joined(v) -> F.Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


def quantize_query(spark: SparkSession, sf: str) -> DataFrame:
    return _embeddings(spark, sf).select("vec_id", _joined(vectors.quantised_query(F.col("embedding"))).alias("bytes"))


def quantize_document(spark: SparkSession, sf: str) -> DataFrame:
    return _embeddings(spark, sf).select("vec_id", _joined(vectors.quantised_document(F.col("embedding"))).alias("bytes"))


def _searched(spark: SparkSession, sf: str, k: int) -> DataFrame:
    rows = _embeddings(spark, sf)
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), vectors.quantised_query(F.col("embedding")).alias("q"))
    return vectors.top_matches(asked, rows.select(F.col("vec_id").alias("id"), vectors.quantised_document(F.col("embedding")).alias("v")), k)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 50, against all vectors."""
    return _searched(spark, sf, 20).select("query_id", "id", "dot", "place")


def evidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Matches by query and evidence band."""
    return _searched(spark, sf, 192).select("query_id", vectors.band(vectors.score(F.col("dot"))).alias("band")).groupBy("query_id", "band").agg(F.count("*").alias("matches"))


def quantisation_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mean difference of the quantised from the exact cosine over the matches of each query."""
    rows = _embeddings(spark, sf)
    found = _searched(spark, sf, 20)
    a = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"))
    b = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("b"))
    exact = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x) / vectors.norm(F.col("a")) / vectors.norm(F.col("b"))
    both = found.join(a, "query_id").join(b, "id").select("query_id", (F.col("dot") / 16129 - exact).alias("e"))
    return both.groupBy("query_id").agg(F.round(F.avg(F.abs("e")), 5).alias("mean_error"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    rows = _embeddings(spark, sf)
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return asked.join(rows.select(F.col("vec_id").alias("item"), "label"), "label").filter("item <> query_id").select("query_id", "item", (F.lit(1) + F.col("item") % 3).cast("int").alias("grade"))


def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = _searched(spark, sf, 9).filter("id <> query_id").select("query_id", F.col("id").alias("item"), "place")
    m = evaluate.ranked_metrics(found, _judged(spark, sf), 8)
    return m.select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "hits", F.round("recall", 6).alias("recall"))


def label_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics by label and over all queries, from one pass with grouping sets."""
    labels = _embeddings(spark, sf).select(F.col("vec_id").alias("query_id"), "label")
    joined = ranking_metrics(spark, sf).join(labels, "query_id")
    return joined.rollup("label").agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("reciprocal_rank"), 5).alias("mrr"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda b: np.frombuffer(b, dtype=np.int8).astype(np.int32))


def _text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, v, scope_mask) of the texts from the blocks that hold their vectors."""
    blocks = table(spark, sf, "vector_blocks").filter("octet_length(data) = 64 * vector_count")
    cut = lambda i: F.struct((F.col("first_vector_id") + i).alias("id"), F.substring("data", i * 64 + 1, F.lit(64)).alias("v"))
    rows = blocks.select(F.inline(F.transform(F.sequence(F.lit(0), F.col("vector_count") - 1), cut)))  # a block isn't carried along with each of its rows
    parts = rows.select("id", _bytes("v").alias("v"))
    return parts.join(table(spark, sf, "texts").select("id", "scope_mask"), "id")


def _text_matches(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The k texts of greatest dot product that share a scope with each text whose id is divisible by 50."""
    v = _text_vectors(spark, sf)
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "scope_mask")
    return vectors.top_matches(asked, v, k, mask=True)


def text_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 texts of greatest dot product that share a scope with each text whose id is divisible by 50."""
    return _text_matches(spark, sf, 20).select("query_id", "id", "dot", "place")


def _evidence(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    """The first `limit` groups behind the pool of texts that such a page needs."""
    there = table(spark, sf, "search_documents").select("id", "entry_id", "headword", "weight", "semantic_role", "text_id").filter("id is not null and text_id is not null and entry_id is not null")
    docs = there.distinct().withColumns(
        {"role": X.ranked(F.col("semantic_role"), reverse.C.RETRIEVAL_ROLE), "evidence_role": X.ranked(F.col("semantic_role"), reverse.C.EVIDENCE_ROLE)}
    )
    return vectors.evidence_groups(_text_matches(spark, sf, vectors.pool_size(0, limit)), docs, "text_id", limit)


def semantic_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and evidence behind the nearest texts of each text whose id is divisible by 50."""
    return _evidence(spark, sf, 20)


def _match_columns() -> list[F.Column]:
    """key, ranks of the role, and whether it protects a lexical match, of search documents."""
    path = F.array_join(F.from_json("path_json", "array<string>"), "\x1f")
    key = F.concat_ws("\x00", *(F.coalesce(c, F.lit("")) for c in (*map(F.col, ("scope", "english_text", "chinese_text", "section", "part", "owner_id")), path)))
    role = F.col("semantic_role")
    ranks = [X.ranked(role, reverse.C.RETRIEVAL_ROLE).alias("role"), X.ranked(role, reverse.C.EVIDENCE_ROLE).alias("evidence_role")]
    return [key.alias("key"), *ranks, F.coalesce(role.isin("definition", "guidance"), F.lit(False)).alias("protecting")]


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Reverse search for the texts whose id is divisible by 50, fused with the entries behind their nearest texts.

    Windows of GROUP_LIMIT groups of either side are fused by their merged matches, and all that is fused is ranked; a page is a
    range of places. tier is that of the strongest lexical match that protects its entry, a definition or guidance of tier 3 or 4.
    """
    texts = table(spark, sf, "texts").filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("normalized_chinese_text").alias("query"))
    docs = _docs(spark, sf).filter("entry_id is not null")
    window = reverse.C.GROUP_LIMIT
    lexical = reverse.search(texts, docs, window).select("query_id", "id", "tier", F.col("evidence_place").alias("lexical_at"), F.col("group_place").alias("lexical_place"))
    semantic = _evidence(spark, sf, window).select("query_id", "id", "dot", F.col("evidence_place").alias("semantic_at"), F.col("group_place").alias("semantic_place"))
    matches = lexical.unionByName(semantic, allowMissingColumns=True).join(docs.select("id", "entry_id", *_match_columns()), "id")
    found = vectors.placed(vectors.profiled(vectors.merged_matches(matches)))
    return found.select("query_id", "entry_id", "tier", "lexical_place", "semantic_place", "place")


_Q = "q AS (SELECT vec_id AS query_id, [greatest(-127, least(127, round(x::DOUBLE / n * 127)))::INT FOR x IN embedding] AS q FROM (SELECT *, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings WHERE embedding IS NOT NULL))"
_V = "v AS (SELECT vec_id AS id, [round_even(greatest(-127.0, least(127.0, (x * 127::FLOAT)::DOUBLE)), 0)::INT FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL)"
_TOP = f"{_Q}, {_V}, top AS (SELECT query_id, id, dot, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS place FROM (SELECT query_id, id, list_dot_product(q, v)::INT AS dot FROM q, v WHERE query_id % 50 = 0))"
_METRICS = f"""{_TOP}, judged AS (SELECT a.vec_id AS query_id, b.vec_id AS item, 1 + b.vec_id % 3 AS grade FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  ideal AS (SELECT query_id, sum(CASE WHEN n <= 8 THEN (pow(2, grade) - 1) / log2(n + 1) END) AS ideal, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) AS wanted
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item) AS n FROM judged) GROUP BY 1),
  found AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(place + 1)) AS gain, min(CASE WHEN grade >= 2 THEN place END) AS first, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) AS hits
    FROM top JOIN judged USING (query_id) WHERE id = item AND place <= 8 GROUP BY 1),
  metrics AS (SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(gain, 0) / ideal ELSE 0 END, 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, coalesce(hits, 0)::INT AS hits,
    round(CASE WHEN wanted > 0 THEN coalesce(hits, 0) / wanted END, 6) AS recall FROM ideal LEFT JOIN found USING (query_id))"""

_TV = """tb AS (SELECT first_vector_id + i AS id, hex(data[i * 64 + 1 : i * 64 + 64]) AS h FROM vector_blocks, LATERAL (SELECT unnest(range(0, vector_count)) AS i) WHERE octet_length(data) = 64 * vector_count),
  tn AS (SELECT id, scope_mask, [instr('0123456789ABCDEF', h[2 * j - 1]) * 16 + instr('0123456789ABCDEF', h[2 * j]) - 17 FOR j IN range(1, 65)] AS b FROM tb JOIN texts USING (id)),
  tv AS (SELECT id, scope_mask, [(CASE WHEN x > 127 THEN x - 256 ELSE x END)::FLOAT FOR x IN b] AS v FROM tn)"""


def _pool(k: int) -> str:
    return f"""{_TV}, pool AS (SELECT a.id AS query_id, b.id, list_dot_product(a.v, b.v)::INT AS dot, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS place
    FROM tv a JOIN tv b ON a.id % 50 = 0 AND (a.scope_mask & b.scope_mask) <> 0 QUALIFY place <= {k})"""


QUERIES = {
    "vector_norms": vector_norms,
    "quantize_query": quantize_query,
    "quantize_document": quantize_document,
    "vector_topk": vector_topk,
    "evidence_bands": evidence_bands,
    "quantisation_error": quantisation_error,
    "ranking_metrics": ranking_metrics,
    "label_macro": label_macro,
    "text_topk": text_topk,
    "semantic_groups": semantic_groups,
    "hybrid_search": hybrid_search,
}
ORACLE = {
    "vector_norms": "SELECT vec_id, round(n, 6) AS norm, n > 0 AND NOT isnan(n) AND n < 'inf'::DOUBLE AS usable FROM (SELECT vec_id, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings)",
    "quantize_query": f"WITH {_Q} SELECT query_id AS vec_id, array_to_string(q, ',') AS bytes FROM q",
    "quantize_document": f"WITH {_V} SELECT id AS vec_id, array_to_string(v, ',') AS bytes FROM v",
    "vector_topk": f"WITH {_TOP} SELECT query_id, id, dot, place::INT AS place FROM top WHERE place <= 20",
    "evidence_bands": f"WITH {_TOP} SELECT query_id, round((dot / 16129)::FLOAT::DOUBLE / 0.004999999888241291)::INT AS band, count(*) AS matches FROM top WHERE place <= 192 GROUP BY 1, 2",
    "quantisation_error": f"""WITH {_TOP}, e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS x FROM embeddings)
        SELECT query_id, round(avg(abs(dot / 16129 - list_cosine_similarity(a.x, b.x))), 5) AS mean_error FROM top JOIN e a ON a.vec_id = query_id JOIN e b ON b.vec_id = id WHERE place <= 20 GROUP BY 1""",
    "ranking_metrics": f"WITH {_METRICS} SELECT query_id, ndcg, reciprocal_rank, hits, recall FROM metrics",
    "text_topk": f"WITH {_pool(20)} SELECT query_id, id, dot, place::INT AS place FROM pool",
    "semantic_groups": f"""WITH {_pool(504)}, d AS (SELECT DISTINCT id, entry_id, headword, weight, semantic_role, text_id FROM search_documents WHERE id IS NOT NULL AND text_id IS NOT NULL AND entry_id IS NOT NULL),
        r AS (SELECT query_id, dot, d.id, entry_id, headword, coalesce(weight, 0) AS w, round((dot / 16129)::FLOAT::DOUBLE / 0.004999999888241291) AS band,
          CASE WHEN semantic_role IN ('definition', 'guidance', 'expression', 'example') THEN 2 WHEN semantic_role IN ('qualifier', 'context') THEN 1 WHEN semantic_role = 'heading' THEN 0 ELSE -1 END AS role,
          CASE WHEN semantic_role IN ('definition', 'expression') THEN 3 WHEN semantic_role IN ('guidance', 'example') THEN 2 WHEN semantic_role IN ('qualifier', 'context') THEN 1 WHEN semantic_role = 'heading' THEN 0 ELSE -1 END AS evidence FROM pool JOIN d ON pool.id = text_id),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY band DESC, role DESC, dot DESC, w DESC, entry_id, headword NULLS FIRST, id) AS place,
          row_number() OVER (PARTITION BY query_id, entry_id ORDER BY band DESC, evidence DESC, dot DESC, w DESC, headword NULLS FIRST, id) AS evidence_place FROM r),
        f AS (SELECT *, min(place) OVER (PARTITION BY query_id, entry_id) AS first FROM p QUALIFY evidence_place <= 8)
        SELECT query_id, group_place::INT AS group_place, evidence_place::INT AS evidence_place, entry_id, id, dot FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS group_place FROM f) WHERE group_place <= 20""",
    "label_macro": f"WITH {_METRICS} SELECT label, count(*) AS queries, round(avg(ndcg), 5) AS ndcg, round(avg(reciprocal_rank), 5) AS mrr FROM metrics JOIN embeddings ON vec_id = query_id GROUP BY ROLLUP (label)",
}
