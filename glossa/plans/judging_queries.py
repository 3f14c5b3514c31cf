"""Judging of searches, on the vectors of embeddings and the cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import judging as J
from glossa.operators import vectors
from glossa.plans.semantic_queries import _TOP, _embeddings, _searched
from glossa.session import table

#: Stand-ins of the vectors' documents: entry and headword by the id.
ENTRIES, HEADS = 80, 40


def _head(v) -> F.Column:
    return F.concat(F.lit("w"), (v % HEADS).cast("string"))


def best_headwords(spark: SparkSession, sf: str) -> DataFrame:
    """The headwords of every vector whose id is divisible by 50, each with its best vector, ranked."""
    rows = _embeddings(spark, sf)
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), vectors.quantised_query(F.col("embedding")).alias("q"))
    there = rows.select(F.col("vec_id").alias("id"), vectors.quantised_document(F.col("embedding")).alias("v"), _head(F.col("vec_id")).alias("headword"))
    return J.best_heads(asked, there)


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    q = _embeddings(spark, sf).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return q.select("query_id", F.explode(F.array(_head(F.col("query_id") + 3), _head(F.col("query_id") + F.col("label")))).alias("headword")).distinct()


def target_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and reciprocal ranks of target headwords by label of the query."""
    labels = _embeddings(spark, sf).select(F.col("vec_id").alias("query_id"), "label")
    found = J.rank_quality(J.target_ranks(best_headwords(spark, sf), _targets(spark, sf)).join(labels, "query_id"), "label")
    return found.select("label", "queries", *(F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "reciprocal_rank")))


def _listed(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """(query_id, entry_id, entry_place, match, match_place) of the first k vectors, as a search lists them."""
    return _places(_searched(spark, sf, k).select("query_id", F.col("id").alias("match"), (F.col("id") % ENTRIES).alias("entry_id"), "place"))


def _places(found: DataFrame) -> DataFrame:
    entry = J.Window.partitionBy("query_id", "entry_id")
    first = found.withColumns({"_f": F.min("place").over(entry), "match_place": F.row_number().over(entry.orderBy("place"))})
    return first.withColumn("entry_place", F.dense_rank().over(J.Window.partitionBy("query_id").orderBy("_f"))).drop("_f", "place")


def target_recall(spark: SparkSession, sf: str) -> DataFrame:
    found = _searched(spark, sf, 192).select("query_id", (F.col("id") % ENTRIES).alias("entry_id"), _head(F.col("id") % ENTRIES).alias("headword"), F.col("place").alias("at"))
    wanted = _targets(spark, sf)
    summary = J.recall_summary(J.entry_ranks(found, wanted, 32), wanted, (1, 3, 8, 32))
    return summary.select("cutoff", "queries", *(F.round(c, 6).alias(c) for c in ("hit", "recall", "reciprocal_rank")))


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh vector is expected evidence of the queries with the same remainder."""
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("match"))
    queries = rows.filter("match % 50 = 0").select(F.col("match").alias("query_id"))
    pairs = queries.withColumn("r", F.col("query_id") % 7).join(rows.filter("match % 5 = 2").withColumn("r", F.col("match") % 7), "r")
    return pairs.select("query_id", (F.col("match") % ENTRIES).alias("entry_id"), (F.col("match") % 3).alias("scope"), "match", (F.lit(1) + F.col("match") % 3).cast("int").alias("grade"))


def evidence_quality(spark: SparkSession, sf: str) -> DataFrame:
    m = J.evidence_metrics(_listed(spark, sf, 60), _expected(spark, sf))
    return m.select("query_id", "targets", "groups", "hits_at_1", "hits_at_3", "hits_at_8", F.round("ndcg_sum", 6).alias("ndcg_sum"), F.round("reciprocal_sum", 6).alias("reciprocal_sum"))


def preferred_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """How far the nearest vectors begin with those of the query's label, tier by id."""
    found = _searched(spark, sf, 9).filter("id <> query_id").select("query_id", F.col("id").alias("item"), "place")
    at = J.Window.partitionBy("query_id").orderBy("place")
    found = found.withColumn("place", F.row_number().over(at))
    preferred = found.filter("item % 4 > 0").select("query_id", "item", (F.col("item") % 4).cast("int").alias("tier"))
    return J.preferred_metrics(found, preferred).withColumn("ndcg", F.round("ndcg", 6))


def outcome_rates(spark: SparkSession, sf: str) -> DataFrame:
    found = _searched(spark, sf, 8).select("query_id", F.col("id").alias("item"), (F.col("id") % 5).alias("scope"))
    cases = _embeddings(spark, sf).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("label") % 3 == 0).alias("gap"))
    forbidden = found.filter("item % 11 = 4").select("query_id", "item")
    allowed = cases.select("query_id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("scope"))
    rates = J.outcome_rates(found, cases, forbidden, allowed)
    return rates.select("cases", *(F.round(c, 6).alias(c) for c in rates.columns if c != "cases"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "threshold_cases").drop("added_at").distinct()


def unanchored_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of cases that no entry of the main dictionary has as its headword, with the cases that name them."""
    wanted = _cases(spark, sf).select("id", F.explode("targets").alias("headword"))
    return J.unanchored(wanted, table(spark, sf, "entries").filter("dictionary_id = 'lexa-main'"), "headword").groupBy("headword").agg(F.countDistinct("id").alias("cases"))


def target_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that the targets of answerable cases name, by entry for even case numbers and by headword for the others."""
    c = _cases(spark, sf).filter("label = 'answerable'").select(F.col("id").alias("query_id"), F.explode("targets").alias("headword")).distinct()
    e = table(spark, sf, "entries").select(F.col("id").alias("item"), "headword")
    items = c.join(e, "headword").select("query_id", "item", "headword").distinct()
    even = F.length("headword") % 2 == 0
    targets = items.select("query_id", F.when(even, F.col("item")).alias("entry_id"), F.when(~even, F.upper("headword")).alias("headword"), F.when(even, 3).otherwise(2).alias("grade"))
    return J.identified(items, targets, X.normalized_headword)


def preference_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed labels laid over the cases: the faulty preferences by what is wrong."""
    cases = _cases(spark, sf).filter("query is not null").select("query", "label")
    reviewed = _cases(spark, sf).filter("split = 'holdout' and query is not null").select("query", F.lit("reject").alias("label"))
    _, faults = J.overlaid(cases, reviewed, "query", "label")
    return faults.groupBy("cases", "preferences").agg(F.count("*").alias("queries"))


def length_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Cases by split and band of the query's length, and how many of each a set of at most twenty would take."""
    c = _cases(spark, sf).filter("query is not null").withColumn("band", J.length_band(F.length("query"), (10, 20, 30, 40)))
    taken = J.quota(c.select("id", "split", "band").distinct(), ["split", "band"], "id", "glossa-2", 20).groupBy("split", "band").agg(F.count("*").alias("taken"), F.min("id").alias("least_id"))
    total = c.groupBy("split", "band").agg(F.countDistinct("id").alias("ids"))
    return total.join(taken.withColumnsRenamed({"split": "_s", "band": "_b"}), F.col("split").eqNullSafe(F.col("_s")) & (F.col("band") == F.col("_b"))).select("split", "band", "ids", "taken", "least_id")


_HEADS = f"""{_TOP}, h AS (SELECT query_id, 'w' || (id % {HEADS}) AS headword, max(dot) AS dot, min_by(id, -dot::BIGINT * 1000000000 + id) AS id FROM top GROUP BY 1, 2),
  heads AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id, headword) AS place FROM h)"""
_TARGETS = f"targets AS (SELECT DISTINCT vec_id AS query_id, unnest(['w' || ((vec_id + 3) % {HEADS}), 'w' || ((vec_id + label) % {HEADS})]) AS headword FROM embeddings WHERE vec_id % 50 = 0)"
_CASES = "c AS (SELECT DISTINCT * EXCLUDE (added_at) FROM threshold_cases)"

QUERIES = {f.__name__: f for f in (best_headwords, target_quality, target_recall, evidence_quality, preferred_prefix, outcome_rates, unanchored_targets, target_identity, preference_overlay, length_bands)}
ORACLE = {
    "best_headwords": f"WITH {_HEADS} SELECT query_id, headword, dot, id, place::INT AS place FROM heads",
    "target_quality": f"""WITH {_HEADS}, {_TARGETS}, r AS (SELECT query_id, min(place) AS r FROM targets LEFT JOIN heads USING (query_id, headword) GROUP BY 1)
        SELECT label, count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3, round(avg(coalesce(1 / r, 0)), 6) AS reciprocal_rank
        FROM r JOIN embeddings ON vec_id = query_id GROUP BY 1""",
    "target_recall": f"""WITH {_TOP}, {_TARGETS}, o AS (SELECT query_id, id % {ENTRIES} AS e, min(place) AS f FROM top WHERE place <= 192 GROUP BY 1, 2),
        p AS (SELECT query_id, 'w' || (e % {HEADS}) AS headword, row_number() OVER (PARTITION BY query_id ORDER BY f) AS place FROM o),
        r AS (SELECT query_id, headword, min(place) AS place FROM p JOIN targets USING (query_id, headword) WHERE place <= 32 GROUP BY 1, 2),
        n AS (SELECT query_id, count(*) AS wanted FROM targets GROUP BY 1), k AS (SELECT unnest([1, 3, 8, 32]) AS cutoff),
        b AS (SELECT query_id, wanted, cutoff, count(CASE WHEN place <= cutoff THEN 1 END) AS n, min(place) AS first FROM n CROSS JOIN k LEFT JOIN r USING (query_id) GROUP BY 1, 2, 3)
        SELECT cutoff, count(*) AS queries, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END), 6) AS hit, round(avg(n / wanted), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS reciprocal_rank FROM b GROUP BY 1""",
    "evidence_quality": f"""WITH {_TOP}, l AS (SELECT query_id, id AS match, id % {ENTRIES} AS e, place, min(place) OVER (PARTITION BY query_id, id % {ENTRIES}) AS f FROM top WHERE place <= 60),
        p AS (SELECT query_id, match, dense_rank() OVER (PARTITION BY query_id ORDER BY f) AS ep, row_number() OVER (PARTITION BY query_id, e ORDER BY place) AS mp FROM l),
        x AS (SELECT a.vec_id AS query_id, b.vec_id AS match, b.vec_id % {ENTRIES} AS e, b.vec_id % 3 AS scope, 1 + b.vec_id % 3 AS grade FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id % 5 = 2 AND a.vec_id % 7 = b.vec_id % 7),
        m AS (SELECT x.*, ep, mp, row_number() OVER (PARTITION BY x.query_id, e, scope ORDER BY grade DESC, x.match) AS ia FROM x LEFT JOIN p ON p.query_id = x.query_id AND p.match = x.match),
        t AS (SELECT query_id, count(*) AS targets, count(CASE WHEN ep <= 1 THEN 1 END) AS hits_at_1, count(CASE WHEN ep <= 3 THEN 1 END) AS hits_at_3, count(CASE WHEN ep <= 8 THEN 1 END) AS hits_at_8, sum(coalesce(1 / mp, 0)) AS rs FROM m GROUP BY 1),
        g AS (SELECT query_id, e, scope, coalesce(sum(CASE WHEN mp <= 3 THEN (pow(2, grade) - 1) / log2(mp + 1) END), 0) / sum(CASE WHEN ia <= 3 THEN (pow(2, grade) - 1) / log2(ia + 1) END) AS n FROM m GROUP BY 1, 2, 3),
        h AS (SELECT query_id, count(*) AS groups, sum(n) AS s FROM g GROUP BY 1)
        SELECT query_id, targets, groups, hits_at_1, hits_at_3, hits_at_8, round(s, 6) AS ndcg_sum, round(rs, 6) AS reciprocal_sum FROM t JOIN h USING (query_id)""",
    "preferred_prefix": f"""WITH {_TOP}, f AS (SELECT query_id, id % 4 AS tier, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM top WHERE place <= 9 AND id <> query_id),
        w AS (SELECT query_id, list_sort(list(tier))[:3] AS ideal FROM f WHERE tier > 0 GROUP BY 1), t AS (SELECT query_id, list(tier ORDER BY place) AS tiers FROM f WHERE place <= 3 GROUP BY 1)
        SELECT query_id, len(ideal)::INT AS width, tiers[1] = 1 AS first, list_sort(tiers[:len(ideal)]) = ideal AS prefix_set, tiers[:len(ideal)] = ideal AS prefix_order,
          round(list_sum([CASE WHEN tiers[i] > 0 THEN (pow(2, 4 - tiers[i]) - 1) / log2(i + 1) ELSE 0 END FOR i IN range(1, len(tiers) + 1)]) / list_sum([(pow(2, 4 - ideal[i]) - 1) / log2(i + 1) FOR i IN range(1, len(ideal) + 1)]), 6) AS ndcg FROM w JOIN t USING (query_id)""",
    "outcome_rates": f"""WITH {_TOP}, f AS (SELECT query_id, id % 11 = 4 AS bad, id % 5 > 2 AS leaked FROM top WHERE place <= 8),
        p AS (SELECT query_id, count(*) AS n, sum(bad::INT) AS bad, sum(leaked::INT) AS leaked FROM f GROUP BY 1), c AS (SELECT vec_id AS query_id, label % 3 = 0 AS gap FROM embeddings WHERE vec_id % 50 = 0),
        b AS (SELECT gap, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(leaked, 0) AS leaked FROM c LEFT JOIN p USING (query_id))
        SELECT count(*) AS cases, round(sum(bad) / sum(n), 6) AS forbidden_items, round(avg((bad > 0)::INT), 6) AS forbidden_cases, round(sum(leaked) / sum(n), 6) AS leaked_items, round(avg((leaked > 0)::INT), 6) AS leaked_cases,
          round(avg(CASE WHEN gap THEN (n > 0)::INT END), 6) AS gap_nonempty FROM b""",
    "unanchored_targets": f"WITH {_CASES} SELECT headword, count(DISTINCT id) AS cases FROM (SELECT id, unnest(targets) AS headword FROM c) WHERE headword IS NOT NULL AND headword NOT IN (SELECT headword FROM entries WHERE headword IS NOT NULL AND dictionary_id = 'lexa-main') GROUP BY 1",
    "target_identity": f"""WITH {_CASES}, t AS (SELECT DISTINCT id AS query_id, unnest(targets) AS headword FROM c WHERE label = 'answerable'), i AS (SELECT DISTINCT query_id, e.id AS item, headword FROM t JOIN entries e USING (headword)),
        k AS (SELECT *, length(headword) % 2 = 0 AS even, lower(trim(regexp_replace(regexp_replace(headword, '[·ˈˌ]', '', 'g'), '\\s+', ' ', 'g'))) AS h FROM i),
        m AS (SELECT query_id, item, 3 AS grade FROM k WHERE even UNION ALL SELECT a.query_id, a.item, 2 FROM k a JOIN k b ON a.query_id = b.query_id AND a.h = b.h AND NOT b.even)
        SELECT query_id, item, max(grade)::INT AS grade FROM m GROUP BY 1, 2""",
    "preference_overlay": f"""WITH {_CASES}, n AS (SELECT query, count(*) AS cases, count(CASE WHEN split = 'holdout' THEN 1 END) AS preferences FROM c WHERE query IS NOT NULL GROUP BY 1)
        SELECT cases, preferences, count(*) AS queries FROM n WHERE preferences > 0 AND (cases <> 1 OR preferences <> 1) GROUP BY 1, 2""",
    "length_bands": f"""WITH {_CASES}, b AS (SELECT DISTINCT id, split, ((length(query) >= 10)::INT + (length(query) >= 20)::INT + (length(query) >= 30)::INT + (length(query) >= 40)::INT) AS band FROM c WHERE query IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY split, band ORDER BY sha256('glossa-2' || chr(0) || id), id) AS place FROM b)
        SELECT split, band, count(DISTINCT id) AS ids, count(CASE WHEN place <= 20 THEN 1 END) AS taken, min(CASE WHEN place <= 20 THEN id END) AS least_id FROM r GROUP BY 1, 2""",
}
