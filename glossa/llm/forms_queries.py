"""Problem 4: values that look alike in one consistent form, and those that needed it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.textforms import canonical_column, disguised_column, odd
from glossa.session import table

#: Table, key and the fields that hold text of uneven form.
FIELDS = (("search_documents", "id", ("headword", "chinese_text")), ("threshold_cases", "id", ("query",)))


def field_values(df: DataFrame, name: str, key: str, fields: tuple[str, ...], only_odd: bool) -> DataFrame:
    """(table_name, row_key, field, value) of the non-null values; only_odd drops plain ones before they are exploded."""
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    kept = F.filter(values, lambda x: odd(x["value"]) if only_odd else x["value"].isNotNull())
    return df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.inline(kept))


def disguised_values(df: DataFrame, name: str, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(table_name, row_key, field) of each value that looks like a plain spelling but holds other characters.

    One scan, no shuffle before the last step: plain values are set aside in the JVM, the rest is
    judged in Arrow batches once per distinct value, and only what is found goes through distinct
    (redelivered rows). Null and empty values are never found; a null key gives a null row_key.
    """
    values = field_values(df, name, key, fields, only_odd=True)
    return values.filter(disguised_column(F.col("value"))).select("table_name", "row_key", "field").distinct()


def canonical_values(df: DataFrame, name: str, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(table_name, row_key, field, form) of every non-null value, one row for equal rows."""
    values = field_values(df, name, key, fields, only_odd=False)
    return values.withColumn("form", canonical_column(F.col("value"))).drop("value").distinct()


def _union(spark: SparkSession, sf: str, rule) -> DataFrame:
    first, *rest = (rule(table(spark, sf, name), name, key, fields) for name, key, fields in FIELDS)
    for x in rest:
        first = first.unionByName(x)
    return first


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf, disguised_values)


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf, canonical_values)


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
ORACLE: dict[str, str] = {}
