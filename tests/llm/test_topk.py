import random
from collections import defaultdict

from pyspark.sql import functions as F

from glossa.llm.topk import group_edges, group_thresholds, top_per_group


def _brute(rows, n):
    best = defaultdict(dict)
    for g, k, s in rows:
        if g is not None and k is not None and s is not None and s == s:
            best[g][k] = max(s, best[g].get(k, s))
    return {(g, k, s) for g, keys in best.items() for k, s in sorted(keys.items(), key=lambda x: (-x[1], x[0]))[:n]}


def test_equals_brute_force_with_hot_group_and_copies(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.4 else f"g{r.randrange(300)}", r.randrange(4000), r.choice([None, *range(-20, 30)])) for _ in range(20_000)]
    rows += [("hot", 7, 29)] * 3000 + [(None, 1, 5), ("n", None, 5), ("few", 1, -5)]
    df = spark.createDataFrame([(g, k, s, "x", 1) for g, k, s in rows], "grp string, key long, score int, g string, b int")
    for bins in (4, 64):
        found = top_per_group(df, "grp", "score", "key", 5, bins=bins).collect()
        assert {(x.grp, x.key, x.score) for x in found} == _brute(rows, 5)
        assert len(found) == len(_brute(rows, 5))


def test_ties_floats_and_empty(spark):
    rows = [("a", i, 1.0) for i in range(3000)] + [("b", 1, float("nan")), ("b", 2, 0.5), ("b", 3, float("-inf"))]
    df = spark.createDataFrame(rows, "grp string, key long, score double")
    found = top_per_group(df, "grp", "score", "key", 3)
    assert {(x.grp, x.key, x.score, x["rank"]) for x in found.collect()} == {("a", 0, 1.0, 1), ("a", 1, 1.0, 2), ("a", 2, 1.0, 3), ("b", 2, 0.5, 1), ("b", 3, float("-inf"), 2)}
    assert top_per_group(df.limit(0), "grp", "score", "key", 3).count() == 0


def test_a_key_with_scores_in_every_bin_is_one_key(spark):
    rows = [("g", 0, 3000 + i) for i in range(5000)] + [("g", k, k % 2900) for k in range(1, 3001)]
    df = spark.createDataFrame(rows, "grp string, key long, score int")
    for n in (1, 5, 100):
        assert {(x.grp, x.key, x.score) for x in top_per_group(df, "grp", "score", "key", n).collect()} == _brute(rows, n)


def test_ranges_of_groups_and_outliers(spark):
    r = random.Random(2)
    rows = [(f"g{g}", r.randrange(5000), g * 1e6 + r.random()) for g in range(4) for _ in range(3000)]
    rows += [("wide", r.randrange(5000), r.choice([1e308, -1e308, float("inf"), float("-inf"), 1.0, 2.0, 0.0])) for _ in range(3000)]
    rows += [("out", i, float(i % 97)) for i in range(3000)] + [("out", 9999, 1e12), ("endless", 1, float("inf"))] + [("endless", i, float("-inf")) for i in range(500)]
    df = spark.createDataFrame(rows, "grp string, key long, score double")
    assert {(x.grp, x.key, x.score) for x in top_per_group(df, "grp", "score", "key", 7).collect()} == _brute(rows, 7)


def test_thresholds_cut_groups_of_any_range(spark):
    rows = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), (1e9 * (F.col("id") % 2) + F.col("id") / 40_000).alias("s"))
    edges = group_edges(rows, 69)
    floors = {r.g: r.floor for r in group_thresholds(rows.join(edges, "g"), 5, 64).collect()}
    assert set(floors) == {0, 1} and floors[0] > 0.9 and floors[1] > 1e9 + 0.9
