"""Dense numbers in a total order without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a column 0..n-1 in the order given, which must be total for the result to be one.

    Rows are range-partitioned and numbered within their partition, whose first number is the count of rows before it:
    one small row per partition is all that is brought together.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_first", before.alias("_before"))  # one row per partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")
