"""Keyed state from event logs: counters, histories, caches, latest-wins merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(events: DataFrame, key: list[str], time: str, count: Column | None = None) -> DataFrame:
    """(key, count, first and last time) of each key: visit counters."""
    return events.groupBy(*key).agg((F.count("*") if count is None else F.sum(count)).alias("count"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))


def newest(df: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """The `keep` newest rows of each `by`, numbered; Spark cuts groups down in each task before it brings them together."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= keep)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: upsert by order. Aggregated map-side, so a key with many versions is no hot spot."""
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*rest)
    top = df.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return top.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def without_deleted(df: DataFrame, key: list[str], order: list[Column], deleted: Column) -> DataFrame:
    """Latest rows of a change log, keys whose last change deletes them left out."""
    return latest(df.withColumn("_deleted", deleted), key, order).filter(~F.col("_deleted")).drop("_deleted")


def merged_backup(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Union by key where an incoming row wins."""
    both = incoming.withColumn("_first", F.lit(1)).unionByName(current.withColumn("_first", F.lit(0)))
    return latest(both, key, [F.col("_first")]).drop("_first")


def cache_replay(log: DataFrame, cache: str, key: str, time: str, ttl_seconds: int, most: int) -> DataFrame:
    """What a cache with expiry and least-recently-used eviction holds after a log of accesses, per cache.

    Entries created at or before the last time minus the ttl are gone, the others stay if they are among the `most`
    latest used; ties go to the earlier created, then to the smaller key.
    """
    seen = log.groupBy(cache, key).agg(F.min(time).alias("created_at"), F.max(time).alias("accessed_at"))
    end = log.groupBy(cache).agg(F.max(time).alias("_now"))
    alive = seen.join(end, cache).filter(F.col("created_at") > F.col("_now") - F.make_interval(secs=F.lit(ttl_seconds)))
    order = [F.desc("accessed_at"), F.desc("created_at"), F.desc(key)]
    return newest(alive.drop("_now"), [cache], order, most)


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int, *order: str) -> DataFrame:
    """events with a session number per key: a gap longer than gap_seconds begins a new one."""
    w = Window.partitionBy(key).orderBy(time, *order)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    far = at - F.lag(at).over(w) > gap_seconds * 1_000_000
    return events.withColumn("session", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(w))
