"""Session and shared-storage helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent (a local session, as in tests) a temporary folder is used;
    there driver and executors are one process, so a local folder is shared by definition.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = os.path.join(tempfile.gettempdir(), "glossa-shared")
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to shared storage and reads it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Tables that this process stored; they are needed as long as a frame that reads them may run, so they go at its end.
_written: list[str] = []


def drop_stored(spark: SparkSession) -> int:
    """Removes all tables that stored() wrote so far, through the file system that holds them; frames that read them can't run any more."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@atexit.register
def _at_end() -> None:
    """What is left in a local folder goes with the process."""
    for path in _written:
        local = path.removeprefix("file://").removeprefix("file:")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in shared storage; unlike cut() later scans prune its columns."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_parts(spark: SparkSession, parts: Iterable[DataFrame], schema: str, label: str) -> DataFrame:
    """One stored table of all parts, each written before the next is asked for: the plans of earlier parts are over by then."""
    out = stored(spark.createDataFrame([], schema), label)
    path = _written[-1]
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
