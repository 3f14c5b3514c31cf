"""Canonical pieces of dictionary entries: term matches, deduplication by place, labels, usage runs, parts of speech, and reports on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.functions import text as X

#: Matches of a term that a lookup gives.
MATCHES = 16


def term_index(docs: DataFrame) -> DataFrame:
    """(term, entry_id, kind, display, headword, id) of documents (id, entry_id, scope, headword, candidate_text): headwords once per entry, phrases per document.

    The headword of an entry's first document is its own, other spellings are forms. Null and empty terms are left out.
    """
    named = docs.filter("entry_id is not null and headword is not null")
    own = named.groupBy("entry_id").agg(F.min_by("headword", F.struct("id", "headword")).alias("own"))
    spelled = named.select("entry_id", "headword").distinct().join(own, "entry_id")
    none = F.lit(None).cast(docs.schema["id"].dataType)
    kind = F.when(F.col("headword") == F.col("own"), "headword").otherwise("form")
    heads = spelled.select(X.headword_term(F.col("headword")).alias("term"), "entry_id", kind.alias("kind"), F.col("headword").alias("display"), F.col("own").alias("headword"), none.alias("id"))
    # of two spellings with one term the headword counts, then the first
    first = heads.groupBy("term", "entry_id").agg(F.min(F.struct((F.col("kind") != "headword").alias("_k"), "display", "kind", "headword")).alias("f")).select("term", "entry_id", "f.kind", "f.display", "f.headword", none.alias("id"))
    phrases = docs.filter("scope = 'phrase' and entry_id is not null").select(X.headword_term(F.col("candidate_text")).alias("term"), "entry_id", F.lit("phrase").alias("kind"), F.col("candidate_text").alias("display"), "headword", "id")
    return first.unionByName(phrases.distinct()).filter("term <> ''")


def term_matches(queries: DataFrame, index: DataFrame, most: int = MATCHES) -> DataFrame:
    """(query_id, term, entry_id, kind, display, id, place): the first matches of each looked-up term (query_id, term): headwords, forms, then phrases, shorter ones first."""
    kind = F.when(F.col("kind") == "headword", 0).when(F.col("kind") == "form", 1).otherwise(2)
    name = F.when(F.col("kind") == "headword", F.col("display")).otherwise(F.col("headword"))
    order = [kind, F.length("display"), X.ascii_lower(name), "entry_id", "id"]
    met = queries.join(index, "term")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(*order))).filter(F.col("place") <= most)


def deepest(docs: DataFrame, signature: list[Column], depth: Column, order: str) -> DataFrame:
    """One document per signature: the deepest, of equally deep ones the first, at the place of the signature's first document (`position`).

    Aggregated map-side, so a signature with many copies is no hot spot.
    """
    row = F.struct(*docs.columns)
    keyed = docs.select(*(s.alias(f"_s{i}") for i, s in enumerate(signature)), row.alias("_row"), depth.alias("_depth"), F.col(order).alias("_at"))
    best = keyed.groupBy(*(f"_s{i}" for i in range(len(signature)))).agg(F.max_by("_row", F.struct("_depth", -F.col("_at"))).alias("_row"), F.min("_at").alias("position"))
    return best.select("_row.*", "position")


def most_specific(items: DataFrame, owner: list[str], key: str, specificity: Column, order: str) -> DataFrame:
    """Items with the most specific of each key per owner, of equal ones the first; items without a key all stay. `position` is that of the key's first item."""
    empty = F.coalesce(F.trim(key), F.lit("")) == ""
    lone = items.filter(empty).withColumn("position", F.col(order))
    keyed = items.filter(~empty)
    return lone.unionByName(deepest(keyed, [*map(F.col, owner), F.col(key)], specificity, order))


def last_used(log: DataFrame, owner: str, key: str, time: str, capacity: int = 3) -> DataFrame:
    """(owner, key, used_at, place) of the `capacity` keys that each owner used last: what a store with least-recently-used eviction holds."""
    used = log.groupBy(owner, key).agg(F.max(time).alias("used_at"))
    return used.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("used_at"), key))).filter(F.col("place") <= capacity)


def part_key(v: Column) -> Column:
    """A part of speech to compare by: lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(v, r"\s+", " ")))


def distinct_parts(parts: Column) -> Column:
    """Parts of speech, the first of each key, in order; empty and null ones left out."""
    keys = F.transform(parts, part_key)
    pairs = F.filter(F.arrays_zip(parts.alias("text"), keys.alias("key")), lambda x: F.coalesce(x["key"], F.lit("")) != "")
    firsts = F.array_distinct(F.transform(pairs, lambda x: x["key"]))
    return F.transform(firsts, lambda k: F.filter(pairs, lambda x: x["key"] == k)[0]["text"])


def unambiguous_part(parts: Column) -> Column:
    """The only part of speech there is; null where there is none or another."""
    keys = F.array_distinct(F.filter(F.transform(parts, part_key), lambda k: F.coalesce(k, F.lit("")) != ""))
    return F.when(F.size(keys) == 1, keys[0])


def group_ends(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """rows with `first` and `last` of their group in a total order: what belongs to a group as a whole goes to one of its ends.

    From the least and greatest order key of each group, aggregated map-side, instead of a sort of the group.
    """
    at = F.struct(*order)
    ends = rows.groupBy(*by).agg(F.min(at).alias("_least"), F.max(at).alias("_most"))
    on = [rows[b].eqNullSafe(ends[b]) for b in by]
    both = rows.join(ends, on).select(rows["*"], "_least", "_most")
    return both.withColumns({"first": at == F.col("_least"), "last": at == F.col("_most")}).drop("_least", "_most")


def resolved(items: DataFrame, query: Column, is_cjk: Column) -> DataFrame:
    """(query_id, kind, key): one direct target, or all candidates, of a query's items (query_id, query, kind, key, headword).

    A query without Chinese characters goes to its only exact dictionary entry, without any to its only exact article; else all items are candidates.
    """
    once = items.dropDuplicates(["query_id", "kind", "key"])
    exact = F.lower(F.trim("headword")) == F.lower(F.trim(query))
    by = Window.partitionBy("query_id")
    count = lambda kind: F.sum((exact & (F.col("kind") == kind)).cast("int")).over(by)
    marked = once.withColumns({"_d": count("dictionary"), "_e": count("etymology"), "_x": exact})
    wanted = F.when(is_cjk, None).when(F.col("_d") == 1, "dictionary").when((F.col("_d") == 0) & (F.col("_e") == 1), "etymology")
    kept = marked.withColumn("_w", wanted).filter(F.col("_w").isNull() | (F.col("_x") & (F.col("kind") == F.col("_w"))))
    return kept.select("query_id", F.when(F.col("_w").isNull(), "candidates").otherwise("direct").alias("resolution"), "kind", "key")


def semantic_status(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """requests (request_id, route) with `status`: not_eligible, applied, or degraded where hybrid search has no semantic answer (request_id)."""
    there = answered.select("request_id").distinct().withColumn("_there", F.lit(True))
    status = F.when(F.col("route") != "hybrid", "not_eligible").when(F.col("_there"), "applied").otherwise("degraded")
    return requests.join(there, "request_id", "left").withColumn("status", status).drop("_there")


def report(violations: DataFrame, rule: str, *key: str, most: int = 100) -> DataFrame:
    """(rule, violations, place, key...) of the first `most` violations in order of rule and key, each with its rule's count: a report by design."""
    counts = violations.groupBy(rule).agg(F.count("*").alias("violations"))
    first = violations.select(rule, *key).distinct().orderBy(rule, *key).limit(most)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(rule, *key)))  # at most `most` rows
    return placed.join(F.broadcast(counts), rule)  # one row per rule


def entry_weight(labels: Column) -> Column:
    """Weight that an entry's level and frequency labels add to its documents."""
    return X.label_weight(labels)


def document_weight(scope: Column, labels: Column) -> Column:
    return X.ranked(scope, C.SCOPE_WEIGHT, 0) + entry_weight(labels)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in lower-case hex, built from two digests; a key of a cache that doesn't show its query."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad: Callable[[int], Column] = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
