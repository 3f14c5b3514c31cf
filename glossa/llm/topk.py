"""The N best items of every group, whatever the sizes of the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut

#: Groups whose histogram and threshold are broadcast, the largest first (some 10 MB); a bound of memory, the result is the same for all.
BROADCAST_GROUPS = 200_000
#: Bits that count the distinct keys of a cell: 64 for each KEYS_A_WORD of n, in at most MOST_WORDS words.
KEYS_A_WORD, MOST_WORDS = 16, 64


def group_edges(rows: DataFrame, least: int) -> DataFrame:
    """(g, low, high) of groups with more than `least` rows: the range of scores from one deviation under a group's mean to four above it."""
    d = F.col("s").cast("double")
    finite = F.when(F.abs(d) < float("inf"), d)
    by = rows.groupBy("g").agg(F.count("*").alias("rows"), F.min(finite).alias("least"), F.max(finite).alias("most"), F.avg(finite / 2).alias("half"), F.stddev_pop(finite / 2).alias("spread"))
    # halves, so that no sum or difference of two finite scores overflows; a spread that did is no bound
    bound = lambda at, other, pick: F.when(F.isnan(at) | (F.abs(at) == float("inf")), other / 2).otherwise(pick(at, other / 2))
    low, high = bound(F.col("half") - F.col("spread"), F.col("least"), F.greatest), bound(F.col("half") + 4 * F.col("spread"), F.col("most"), F.least)
    return by.filter((F.col("rows") > least) & F.col("half").isNotNull()).select("g", "rows", low.alias("low"), high.alias("high"))


def histogram_bin(score: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a score within half the range [low, high] of its group: 0 below, 1..bins within, bins + 1 above; never falls as the score rises."""
    half = score.cast("double") / 2
    inside = F.when(low < high, F.floor((half - low) / (high - low) * bins) + 1).otherwise(1)
    return F.when(half < low, 0).when(half > high, bins + 1).otherwise(F.least(inside, F.lit(bins))).cast("int")


def group_thresholds(rows: DataFrame, n: int, bins: int) -> DataFrame:
    """(g, floor): a score that at least n distinct keys of group g reach, the highest that its histogram proves.

    rows: (g, k, s, low, high). Each cell of the histogram marks the hashes of its keys in a bit set; the bits of the union of all cells from the top
    down to one are a lower bound of the distinct keys there, however often and with however many scores a key comes. A group
    whose histogram doesn't prove n keys (n over some 3,000, or most keys in the lowest cell) gets no threshold.
    """
    words = min(MOST_WORDS, -(-n // KEYS_A_WORD))
    spot = F.pmod(F.xxhash64("k"), F.lit(64 * words)).cast("int")
    bit = lambda w: F.when(F.floor(spot / 64) == w, F.expr("shiftleft(1L, _spot % 64)")).otherwise(F.lit(0).cast("long"))
    marked = rows.withColumn("_spot", spot).withColumn("b", histogram_bin(F.col("s"), F.col("low"), F.col("high"), bins))
    cells = marked.groupBy("g", "b").agg(F.min("s").alias("least"), F.count("*").alias("rows"), *(F.bit_or(bit(w)).alias(f"m{w}") for w in range(words)))
    above = Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    sure = sum((F.bit_count(F.bit_or(f"m{w}").over(above)) for w in range(words)), F.lit(0))
    return cells.select("g", "least", sure.alias("sure")).filter(F.col("sure") >= n).groupBy("g").agg(F.max("least").alias("floor"))


def top_per_group(df: DataFrame, group: str, score: str, key: str, n: int, bins: int = 64) -> DataFrame:
    """(group, key, score, rank) of the n first keys of every group by score descending, key ascending.

    Rows with a null group, score or key don't count (NaN scores don't either); a key that comes
    several times in a group counts once, with its best score. Groups of fewer than n keys come
    whole, an empty table gives no rows, other columns and their names are ignored.

    Histograms of each group, over its own range of scores, give a safe threshold, rows under it are dropped before they are
    shuffled, and what is left is deduplicated by (group, key) and ranked exactly. A group of up to n + bins rows has
    none: its histogram would shuffle as many rows as it could drop. Neither step puts
    a large group into one task: copies are merged map-side, and the ranking keeps n rows of a group
    per task before it brings the group together, even where all its scores are equal.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(score).alias("s")).filter("g is not null and k is not null and s is not null and not isnan(double(s))")
    edges = cut(group_edges(rows, n + bins).orderBy(F.desc("rows"), "g").limit(BROADCAST_GROUPS).drop("rows"))
    if not edges.isEmpty():
        floors = cut(group_thresholds(rows.join(F.broadcast(edges), "g"), n, bins))
        rows = rows.join(F.broadcast(floors), "g", "left").filter("floor is null or s >= floor")
    best = rows.groupBy("g", "k").agg(F.max("s").alias("s"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "k"))).filter(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("k").alias(key), F.col("s").alias(score), "rank")
