"""Judging of searches: best headwords, target ranks, evidence within entries, preferred beginnings, leaks and rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.evaluate import gain

#: Query vectors that are scored at once; more of them go out in further scans.
QUERIES = 4096


def best_heads(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, headword, dot, id, place): each headword's best vector for each query, ranked by dot product, then id, then headword.

    queries: (query_id, q array<int>), a stated set of at most QUERIES; vectors: (id, v array<int>, headword). One scan; what leaves a batch is one row for
    each query and headword in it, so scores of single vectors are never shuffled.
    """
    asked = queries.select("query_id", "q").limit(QUERIES + 1).toPandas()
    if len(asked) > QUERIES:
        raise ValueError(f"more than {QUERIES} queries")
    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((queries, "query_id"), (vectors, "headword"), (vectors, "id"))]
    schema = ", ".join([*kinds, "dot int"])
    if asked.empty:
        return queries.sparkSession.createDataFrame([], schema + ", place int").select("query_id", "headword", "dot", "id", "place")
    shared = queries.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), np.stack(asked["q"]).astype(np.float32)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        for pdf in batches:
            pdf = pdf.dropna().sort_values(["headword", "id"])
            if pdf.empty:
                continue
            heads = pdf["headword"].to_numpy()
            first = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
            n = len(pdf)
            dots = (q @ np.stack(pdf["v"]).astype(np.float32).T).astype(np.int64)  # exact: sums of products of bytes
            best = np.maximum.reduceat(dots * n + np.arange(n - 1, -1, -1), first, axis=1)  # of equal products the smaller id
            at = n - 1 - best % n
            row = np.repeat(np.arange(len(q)), first.size)
            yield pd.DataFrame({"query_id": names[row], "headword": np.tile(heads[first], len(q)), "id": pdf["id"].to_numpy()[at.ravel()], "dot": (best // n).ravel().astype(np.int32)})

    found = vectors.select("id", "v", "headword").mapInPandas(scan, schema)
    top = found.groupBy("query_id", "headword").agg(F.max(F.struct("dot", (-F.col("id")).alias("less"))).alias("b"))
    rows = top.select("query_id", "headword", "b.dot", (-F.col("b.less")).alias("id"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dot"), "id", "headword")))


def target_ranks(heads: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, best_rank, score): rank of each query's first target headword, and the best target's dot product; null ranks where no target has a vector."""
    met = targets.distinct().join(heads, ["query_id", "headword"], "left")
    return met.groupBy("query_id").agg(F.min("place").alias("best_rank"), F.max("dot").alias("score"))


def rank_quality(ranks: DataFrame, *by: str) -> DataFrame:
    """(by, queries, hit_at_1, hit_at_3, reciprocal_rank) of best ranks; a null rank is a miss."""
    within = lambda k: F.avg(F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0)))
    return ranks.groupBy(*by).agg(F.count("*").alias("queries"), within(1).alias("hit_at_1"), within(3).alias("hit_at_3"), F.avg(F.coalesce(1 / F.col("best_rank"), F.lit(0.0))).alias("reciprocal_rank"))


def entry_ranks(results: DataFrame, targets: DataFrame, top: int) -> DataFrame:
    """(query_id, headword, place): place of the first entry with each target headword, counting each entry once, up to `top`.

    results: (query_id, entry_id, headword, at), at a total order of the documents; targets: (query_id, headword), lower case.
    """
    once = results.groupBy("query_id", "entry_id").agg(F.min(F.struct("at", F.lower("headword").alias("headword"))).alias("f"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("f.at"))).filter(F.col("place") <= top)
    return placed.select("query_id", F.col("f.headword").alias("headword"), "place").join(targets.distinct(), ["query_id", "headword"]).groupBy("query_id", "headword").agg(F.min("place").alias("place"))


def recall_summary(ranks: DataFrame, targets: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """(cutoff, queries, hit, recall, reciprocal_rank) over the queries with a target: share with a target up to the cutoff, mean share of targets found, and mean reciprocal rank."""
    wanted = targets.distinct().groupBy("query_id").agg(F.count("*").alias("wanted"))
    found = ranks.groupBy("query_id").agg(F.min("place").alias("first"), *(F.sum((F.col("place") <= c).cast("int")).alias(f"n{c}") for c in cutoffs))
    both = wanted.join(found, "query_id", "left")
    per = both.select("*", F.inline(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.coalesce(f"n{c}", F.lit(0)).alias("n")) for c in cutoffs))))
    return per.groupBy("cutoff").agg(
        F.count("*").alias("queries"), F.avg((F.col("n") > 0).cast("double")).alias("hit"), F.avg(F.col("n") / F.col("wanted")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank")
    )


def evidence_metrics(results: DataFrame, expected: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """(query_id, targets, groups, hits_at_..., ndcg_sum, reciprocal_sum): how expected evidence ranks among its entry's matches.

    results: (query_id, entry_id, entry_place, match, match_place); expected: (query_id, entry_id, scope, match, grade). A target is hit at a cutoff if its entry is up to it and holds the
    match; reciprocal ranks are within the entry, and the gain is over the first three matches of each (entry, scope).
    """
    met = expected.join(results.select("query_id", "entry_id", "entry_place", "match", "match_place"), ["query_id", "entry_id", "match"], "left")
    hits = [F.sum(F.coalesce((F.col("entry_place") <= c).cast("int"), F.lit(0))).alias(f"hits_at_{c}") for c in cutoffs]
    by = met.groupBy("query_id").agg(F.count("*").alias("targets"), *hits, F.sum(F.coalesce(1 / F.col("match_place"), F.lit(0.0))).alias("reciprocal_sum"))
    at = F.row_number().over(Window.partitionBy("query_id", "entry_id", "scope").orderBy(F.desc("grade"), "match"))
    gains = met.withColumn("_at", at).groupBy("query_id", "entry_id", "scope").agg(
        F.sum(F.when(F.col("match_place") <= 3, gain(F.col("grade"), F.col("match_place")))).alias("dcg"), F.sum(F.when(F.col("_at") <= 3, gain(F.col("grade"), F.col("_at")))).alias("ideal")
    )
    ndcg = gains.groupBy("query_id").agg(F.count("*").alias("groups"), F.sum(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)).alias("ndcg_sum"))
    return by.join(ndcg, "query_id")


def preferred_metrics(results: DataFrame, preferred: DataFrame) -> DataFrame:
    """(query_id, width, first, prefix_set, prefix_order, ndcg): how far a result begins with the preferred items.

    results: (query_id, item, place), places from 1; preferred: (query_id, item, tier), tier 1 first. width is the number of preferred items, three at most; the set passes if the first
    `width` items have the tiers of the best `width` preferred ones, the order if they have them in order. Gains are 4 less the tier.
    """
    wanted = preferred.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("tier")), 1, 3).alias("ideal"))  # at most three tiers are kept
    tiers = preferred.groupBy("query_id", "item").agg(F.min("tier").alias("tier"))
    first = results.filter("place <= 3").join(tiers, ["query_id", "item"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("tier", F.lit(0)).alias("tier")))).alias("top"))
    both = wanted.join(first, "query_id", "left").withColumn("tiers", F.coalesce(F.transform("top", lambda x: x["tier"]), F.array().cast("array<int>")))
    width = F.size("ideal")
    actual = F.slice("tiers", F.lit(1), width)
    discounted = lambda xs: F.aggregate(F.zip_with(xs, F.sequence(F.lit(1), F.size(xs)), lambda t, i: F.when(t > 0, gain(F.lit(4) - t, i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    dcg = F.when(F.size("tiers") > 0, discounted(F.col("tiers"))).otherwise(0.0)
    return both.select(
        "query_id", width.alias("width"), F.coalesce(F.try_element_at("tiers", F.lit(1)) == 1, F.lit(False)).alias("first"), (F.array_sort(actual) == F.col("ideal")).alias("prefix_set"),
        (actual == F.col("ideal")).alias("prefix_order"), (dcg / discounted(F.col("ideal"))).alias("ndcg"),
    )


def outcome_rates(results: DataFrame, cases: DataFrame, forbidden: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row of rates over cases (query_id, gap): forbidden items and cases, items and cases outside the allowed scopes, and gaps with any result.

    results: (query_id, item, scope); forbidden: (query_id, item); allowed: (query_id, scope).
    """
    bad = forbidden.select("query_id", "item").distinct().withColumn("_bad", F.lit(1))
    good = allowed.select("query_id", "scope").distinct().withColumn("_good", F.lit(1))
    marked = results.join(bad, ["query_id", "item"], "left").join(good, ["query_id", "scope"], "left")
    per = marked.groupBy("query_id").agg(F.count("*").alias("returned"), F.count("_bad").alias("bad"), F.sum(F.col("_good").isNull().cast("long")).alias("leaked"))
    both = cases.join(per, "query_id", "left").na.fill(0, ["returned", "bad", "leaked"])
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    items = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("returned")), F.lit(0.0))
    return both.agg(
        F.count("*").alias("cases"), items("bad").alias("forbidden_items"), share("bad").alias("forbidden_cases"), items("leaked").alias("leaked_items"), share("leaked").alias("leaked_cases"),
        F.avg(F.when(F.col("gap"), (F.col("returned") > 0).cast("double"))).alias("gap_nonempty"),
    )


def unanchored(cases: DataFrame, corpus: DataFrame, *on: str) -> DataFrame:
    """Rows of cases that no row of the corpus supports: expectations without evidence."""
    return cases.join(corpus.select(*on).distinct(), list(on), "left_anti")


def overlaid(cases: DataFrame, preferences: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(cases with the reviewed value, faults): a preference must meet exactly one case and come once; those that don't are faults (key, cases, preferences)."""
    n = cases.groupBy(key).agg(F.count("*").alias("cases"))
    m = preferences.groupBy(key).agg(F.count("*").alias("preferences"))
    faults = m.join(n, key, "left").na.fill(0, ["cases"]).filter("cases <> 1 or preferences <> 1").select(key, "cases", "preferences")
    once = preferences.join(faults.select(key), key, "left_anti").select(key, F.col(value).alias("_new"))
    return cases.join(once, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new"), faults


def identified(items: DataFrame, targets: DataFrame, normal) -> DataFrame:
    """(query_id, item, grade): items that a target names by entry or, where it has none, by its headword in normal form.

    items: (query_id, item, headword); targets: (query_id, entry_id, headword, grade). Two equi-joins; the greatest grade of an item counts.
    """
    by_entry = items.join(targets.filter("entry_id is not null").select("query_id", F.col("entry_id").alias("item"), "grade"), ["query_id", "item"])
    named = targets.filter("entry_id is null and headword is not null").select("query_id", normal(F.col("headword")).alias("_h"), "grade")
    by_name = items.withColumn("_h", normal(F.col("headword"))).join(named, ["query_id", "_h"])
    return by_entry.select("query_id", "item", "grade").unionByName(by_name.select("query_id", "item", "grade")).groupBy("query_id", "item").agg(F.max("grade").alias("grade"))


def length_band(n: Column, edges: tuple[int, ...]) -> Column:
    """Band of a length: 0 below the first edge, then one more from each edge on."""
    return sum(((n >= e).cast("int") for e in edges), F.lit(0))


def quota(df: DataFrame, by: list[str], key: str, seed: str, n: int) -> DataFrame:
    """The n rows of each band that a hash with the seed puts first: a sample by design, the same on every run."""
    rank = F.sha2(F.concat(F.lit(seed + "\0"), F.col(key)).cast("binary"), 256)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(rank, key))).filter(F.col("place") <= n)
