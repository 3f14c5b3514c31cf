"""Streams of visits: counters by key and window, and a cache with expiry, from events that come late or twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def visit_windows(events: DataFrame, key: str, time: str, unique: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, key, visits, last_at) per time window; an event delivered again within `late` counts once, a later one is dropped."""
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark([unique])
    return once.groupBy(F.window(time, window), F.col(key)).agg(F.count("*").alias("visits"), F.max(time).alias("last_at"))


def visit_totals(events: DataFrame, key: str, time: str) -> DataFrame:
    """Running (key, visits, last_at), for update mode."""
    return events.groupBy(key).agg(F.count("*").alias("visits"), F.max(time).alias("last_at"))


def expiring(events: DataFrame, key: str, time: str, ttl: str, late: str = "1 hour") -> DataFrame:
    """(key, created_ms, uses) when the entry of a key ends: ttl after its creation in event time, whatever its use."""
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            created, uses = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], "created_ms": [created], "uses": [uses]})
            return
        times = sorted(int(t.value // 1_000_000) for pdf in batches for t in pdf[time])
        created, uses = state.get if state.exists else (times[0], 0)
        done = []
        for t in times:
            if t >= created + millis:
                done.append((name[0], created, uses))
                created, uses = t, 0
            uses += 1
        state.update((created, uses))
        state.setTimeoutTimestamp(max(created + millis, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[key, "created_ms", "uses"])

    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, created_ms long, uses long"
    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(step, schema, "created long, uses long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert(batch: DataFrame, batch_id: int, target: str, key: list[str], order: list) -> None:
    """For foreachBatch: the latest row of each key, as version `batch_id` of the table `target`.

    A version is a folder of its own that counts once its success mark is written, so a crash leaves the version before as it is, and a batch that comes
    again is merged with the version before it and gives the same rows. Versions older than the one before are removed.
    """
    from glossa.operators.state import latest

    spark = batch.sparkSession
    done = [v for v in versions(spark, target) if v < batch_id]
    rows = spark.read.parquet(f"{target}/v={done[-1]}").unionByName(batch) if done else batch
    latest(rows, key, order).write.mode("overwrite").parquet(f"{target}/v={batch_id}")
    for old in done[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def versions(spark: SparkSession, target: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("v=")) for f in found)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest complete version of a table."""
    return spark.read.parquet(f"{target}/v={versions(spark, target)[-1]}")
