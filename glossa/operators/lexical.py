"""Prefix and typo-tolerant suggestions for a batch of queries against a term index.

Queries are a DataFrame (query_id, query). A prefix is an equi-join on the term's beginnings of the lengths
that queries have, so neither side is compared with all of the other; every ranking ends with a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.functions import text as X
from glossa.functions import typo


def suggestion_order(name: Column, key: Column) -> list[Column]:
    """Order of suggestions of equal rank: phrases last, shorter first, then by name and id."""
    return [F.when(F.contains(name, F.lit(" ")), 1).otherwise(0), F.length(name), X.ascii_lower(name), key]


def _first(df: DataFrame, partition: list[str], order: list, limit: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(name) <= limit)


def prefix_matches(queries: DataFrame, terms: DataFrame, entries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, entry_id, headword, rank, place): entries with a term that begins with the query; rank 0 for the term itself."""
    spelled = queries.select("query_id", F.explode(X.query_variants(F.col("query"))).alias("prefix")).filter("prefix <> ''").withColumn("size", F.length("prefix"))
    sizes = F.broadcast(spelled.agg(F.array_sort(F.collect_set("size")).alias("sizes")))  # one row of distinct lengths
    begun = terms.crossJoin(sizes).select("term", "entry_id", F.explode(F.filter("sizes", lambda n: n <= F.length("term"))).alias("size"))
    begun = begun.withColumn("prefix", F.substring("term", F.lit(1), F.col("size")))
    is_phrase = F.when(F.contains("term", F.lit(" ")), 1).otherwise(0)
    per = spelled.join(begun, ["prefix", "size"]).groupBy("query_id", "prefix", "entry_id")
    best = per.agg(
        F.min(F.when(F.col("term") == F.col("prefix"), 0).otherwise(1)).alias("rank"), F.min(is_phrase).alias("phrase"), F.min(F.length("term")).alias("size"), F.min("term").alias("sort_term")
    )
    named = best.join(entries.select(F.col("id").alias("entry_id"), "headword"), "entry_id")
    page = _first(named, ["query_id", "prefix"], ["rank", "phrase", "size", X.ascii_lower(F.col("sort_term")), "entry_id"], limit)
    merged = page.groupBy("query_id", "entry_id", "headword").agg(F.min("rank").alias("rank"))
    return _first(merged, ["query_id"], ["rank", *suggestion_order(F.col("headword"), F.col("entry_id"))], limit)


def typo_matches(queries: DataFrame, terms: DataFrame, deletes: DataFrame, entries: DataFrame, limit: int = 20, most: int = C.TYPO_LIMIT) -> DataFrame:
    """(query_id, entry_id, headword, rank, place): entries one edit away, nearest kind of edit first.

    Direct candidates (swaps, deletes) rank by their place, signatures of the deletion index after them. At most `most`
    entries are considered: the direct ones first, then signature by signature in order of headword and id.
    """
    wanted = queries.select("query_id", X.dictionary_key(F.col("query")).alias("q")).filter(typo.eligible(F.col("q")))
    direct = wanted.select("query_id", F.posexplode(typo.direct_candidates(F.col("q"))).alias("rank", "term"))
    hits = direct.join(terms, "term").select("query_id", "entry_id", "rank")
    shift = F.size(typo.direct_candidates(F.col("q")))
    probes = wanted.select("query_id", shift.alias("shift"), F.posexplode(typo.signatures(F.col("q"))).alias("at", "signature"))
    near = probes.join(deletes, "signature").join(terms, "term").select("query_id", "entry_id", (F.col("shift") + F.col("at")).alias("rank"))
    best = hits.unionByName(near).groupBy("query_id", "entry_id").agg(F.min("rank").alias("rank"))
    named = best.join(entries.select(F.col("id").alias("entry_id"), "headword"), "entry_id")
    order = ["rank", X.ascii_lower(F.col("headword")), "entry_id"]
    return _first(_first(named, ["query_id"], order, most, "considered").drop("considered"), ["query_id"], order, limit)


def suggestions(queries: DataFrame, terms: DataFrame, deletes: DataFrame, entries: DataFrame, limit: int = 20) -> DataFrame:
    """Prefix matches, and typo matches (rank shifted by 2) for the queries that have none."""
    found = prefix_matches(queries, terms, entries, limit)
    without = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    typos = typo_matches(without, terms, deletes, entries, limit).withColumn("rank", F.col("rank") + 2)
    cols = ["query_id", "entry_id", "headword", "rank", "place"]
    return found.select(*cols, F.lit("prefix").alias("kind")).unionByName(typos.select(*cols, F.lit("typo").alias("kind")))


def merged(main: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """main and the rows of extra whose key main does not have."""
    return main.unionByName(extra.join(main.select(key).distinct(), key, "left_anti"))


def page(df: DataFrame, query: str, order: list, offset: int, limit: int) -> DataFrame:
    """The rows offset..offset+limit-1 of each query with has_more and next_offset."""
    n = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    near = df.withColumn("place", n).filter(F.col("place") <= offset + limit + 1)  # one more row tells whether there is more
    seen = near.withColumn("_last", F.max("place").over(Window.partitionBy(query)))
    more = F.col("_last") > offset + limit
    rows = seen.withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + limit))}).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return rows.drop("_last")
