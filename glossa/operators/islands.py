"""Ordered scans as windows: islands, forward fill, nesting depth, multiset differences, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: list[str], order: list, starts: Column) -> DataFrame:
    """df with an island number: it rises at every row for which `starts` holds, and the first row is in island 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_s", (starts | first).cast("int")).withColumn("island", F.sum("_s").over(w)).drop("_s")


def changes(value: str, key: list[str], order: list) -> Column:
    """Whether a value differs from that of the row before."""
    return ~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))


def filled(value: Column, key: list[str], order: list) -> Column:
    """The last value that is not null up to each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def with_depth(df: DataFrame, opens: Column, closes: Column, key: list[str], order: list) -> DataFrame:
    """df with the nesting depth after each row, never below 0: the running sum less its least value so far where that is negative."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_run", F.sum(opens.cast("int") - closes.cast("int")).over(w))
    return run.withColumn("depth", F.col("_run") - F.least(F.lit(0), F.min("_run").over(w))).drop("_run")


def multiset_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, missing, unexpected): how often each value is short or in excess on the right; equal values are left out."""
    signed = left.select(*key, F.lit(1).alias("n")).unionByName(right.select(*key, F.lit(-1).alias("n")))
    net = signed.groupBy(*key).agg(F.sum("n").alias("n")).filter("n <> 0")
    return net.select(*key, F.greatest(F.col("n"), F.lit(0)).alias("missing"), F.greatest(-F.col("n"), F.lit(0)).alias("unexpected"))


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that a row breaks; a null outcome is no violation."""
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))
