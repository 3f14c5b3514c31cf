"""Retrieval metrics, intervals, threshold calibration and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.constants import WILSON_Z


def gain(grade: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1)


def ranked_metrics(results: DataFrame, relevant: DataFrame, k: int, good: int = 2) -> DataFrame:
    """(query_id, ndcg, reciprocal_rank, hits, recall) at k for every query with a judgement.

    results: (query_id, item, place); relevant: (query_id, item, grade). The reciprocal rank is that of the first item
    graded `good` or better, recall is over those items.
    """
    ideal_place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item"))
    best = relevant.withColumn("_at", ideal_place).groupBy("query_id").agg(
        F.sum(F.when(F.col("_at") <= k, gain(F.col("grade"), F.col("_at")))).alias("ideal"), F.sum((F.col("grade") >= good).cast("int")).alias("wanted")
    )
    found = results.filter(F.col("place") <= k).join(relevant, ["query_id", "item"]).groupBy("query_id").agg(
        F.sum(gain(F.col("grade"), F.col("place"))).alias("gain"),
        F.min(F.when(F.col("grade") >= good, F.col("place"))).alias("first"),
        F.sum((F.col("grade") >= good).cast("int")).alias("hits"),
    )
    zero = F.lit(0)
    return best.join(found, "query_id", "left").select(
        "query_id",
        F.when(F.col("ideal") > 0, F.coalesce("gain", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce("hits", zero).cast("int").alias("hits"),
        F.when(F.col("wanted") > 0, F.coalesce("hits", zero) / F.col("wanted")).alias("recall"),
    )


def wilson_lower(passed: Column, total: Column, z: float = WILSON_Z) -> Column:
    """Lower bound of the 95 % interval of a rate."""
    p = passed / total
    middle = p + z * z / (2 * total)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)
    return F.when(total > 0, (middle - spread) / (1 + z * z / total))


def thresholds(rows: DataFrame) -> DataFrame:
    """(threshold, above, retention, rejection) of every score as a threshold, itself kept and, with above, itself rejected.

    rows: (score, answerable boolean). Counts from above come from one running sum over the distinct scores, not from a
    product of thresholds and rows.
    """
    per = rows.groupBy("score").agg(F.sum(F.col("answerable").cast("long")).alias("a"), F.sum((~F.col("answerable")).cast("long")).alias("r"))
    totals = F.broadcast(rows.agg(F.sum(F.col("answerable").cast("long")).alias("ta"), F.sum((~F.col("answerable")).cast("long")).alias("tr")))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct score of a labelled set
    run = per.crossJoin(totals).withColumns({"kept": F.sum("a").over(down), "passed": F.sum("r").over(down)})
    both = run.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("above"))
    kept = F.col("kept") - F.when(F.col("above"), F.col("a")).otherwise(0)
    passed = F.col("passed") - F.when(F.col("above"), F.col("r")).otherwise(0)
    return both.select(F.col("score").alias("threshold"), "above", (kept / F.col("ta")).alias("retention"), (1 - passed / F.col("tr")).alias("rejection"))


def calibrated(found: DataFrame, least_retention: float = 0.95) -> DataFrame:
    """The threshold that rejects most among those that retain enough; then more retention, then the greater threshold."""
    return found.filter(F.col("retention") >= least_retention).orderBy(F.desc("rejection"), F.desc("retention"), F.desc("threshold"), F.desc("above")).limit(1)


def pareto(found: DataFrame) -> DataFrame:
    """The (retention, rejection) pairs that no other beats: one pass over pairs in falling retention."""
    pairs = found.groupBy("retention").agg(F.max("rejection").alias("rejection"))
    before = F.max("rejection").over(Window.orderBy(F.desc("retention")).rowsBetween(Window.unboundedPreceding, -1))
    return pairs.withColumn("_b", before).filter("_b is null or rejection > _b").drop("_b")


def floor_percentile(values: Column, p: float) -> Column:
    """Nearest-rank percentile of a collected, bounded array."""
    s = F.array_sort(values)
    return s[F.floor((F.size(s) - 1) * p).cast("int")]


def balance(ledger: DataFrame, account: str, order: list, amount: Column) -> DataFrame:
    """Running balance of reservations, settlements and cancellations."""
    run = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("balance", F.sum(amount).over(run))
