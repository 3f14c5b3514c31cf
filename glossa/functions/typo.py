"""One-edit spelling neighbourhoods as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eligible(v: Column) -> Column:
    """Terms that are corrected: 3 to 64 letters a-z."""
    return v.rlike("^[a-z]{3,64}$")


def deletes(v: Column) -> Column:
    """Distinct terms with one character removed, from the left."""
    n = F.length(v)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, n))))


def signatures(v: Column) -> Column:
    """The term itself, then its deletes: what is looked up in a deletion index."""
    return F.array_distinct(F.concat(F.array(v), deletes(v)))


def direct_candidates(v: Column) -> Column:
    """Neighbour swaps, then deletes, in order; equal neighbours are not swapped."""
    n = F.length(v)
    at = lambda i: F.substring(v, i, F.lit(1))
    swap = lambda i: F.when(at(i) != at(i + 1), F.concat(F.substring(v, F.lit(1), i - 1), at(i + 1), at(i), F.substring(v, i + 2, n)))
    swaps = F.filter(F.transform(F.sequence(F.lit(1), n - 1), swap), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(F.when(n > 1, swaps).otherwise(F.array().cast("array<string>")), deletes(v)))
