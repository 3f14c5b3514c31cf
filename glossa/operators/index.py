"""Index tables of a corpus: terms, deletion signatures, tokens, segments, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.functions import text as X
from glossa.functions import typo
from glossa.operators.ordinals import numbered


def entry_terms(entries: DataFrame, key: str, *names: str) -> DataFrame:
    """(term, entry_id): every distinct key of an entry's names; null and empty terms are left out."""
    terms = F.array(*(X.dictionary_key(F.col(n)) for n in names))
    return entries.select(F.explode(terms).alias("term"), F.col(key).alias("entry_id")).filter("term <> ''").distinct()


def term_deletes(terms: DataFrame) -> DataFrame:
    """(signature, term): deletion neighbourhood of the distinct correctable terms."""
    distinct = terms.select("term").distinct().filter(typo.eligible(F.col("term")))
    return distinct.select(F.explode(typo.deletes(F.col("term"))).alias("signature"), "term").distinct()


def postings(docs: DataFrame, key: str, runs: Column) -> DataFrame:
    """(token, key): the set of single characters and neighbouring pairs of each document."""
    return docs.select(F.explode(X.index_tokens(runs)).alias("token"), F.col(key)).distinct()


def exact_segments(docs: DataFrame, key: str, runs: Column) -> DataFrame:
    """(segment, key): distinct Chinese runs of bounded length."""
    return docs.select(F.explode(F.array_distinct(runs)).alias("segment"), F.col(key)).filter(F.length("segment") <= C.SEGMENT_LENGTH).distinct()


def stride_sample(df: DataFrame, order: str, size: int = 256) -> DataFrame:
    """Every ceil(n / size)-th row in the order of a unique column: a sample by design."""
    step = max(1, -(-df.count() // size))
    return numbered(df, "ordinal", order).filter(F.col("ordinal") % step == 0)


def hashed_sample(df: DataFrame, text: str, seed: str, size: int) -> DataFrame:
    """The `size` texts of least SHA-256(seed, 0, text): a sample by design, the same on every run."""
    rank = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(text)).cast("binary"), 256)
    return df.select(text).distinct().orderBy(rank, text).limit(size)


def corpus_texts(docs: DataFrame, text: Column, scope: Column) -> DataFrame:
    """(id, normalized, scope_mask, documents): distinct texts with the scopes they occur in, ids dense in text order."""
    bits = X.ranked(scope, C.SCOPE_BITS, 0)
    texts = docs.select(text.alias("normalized"), bits.alias("bit")).filter("normalized <> ''").groupBy("normalized")
    return numbered(texts.agg(F.expr("bit_or(bit)").alias("scope_mask"), F.count("*").alias("documents")), "id", "normalized")


def reusable(texts: DataFrame, previous: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose vector can be taken over, rows that need a new one): a text that comes twice in the earlier build counts as new."""
    once = previous.groupBy(on).agg(F.count("*").alias("n")).filter("n = 1").select(on)
    return texts.join(once, on, "left_semi"), texts.join(once, on, "left_anti")


def vector_blocks(vectors: DataFrame, key: str, size: int = 4096) -> DataFrame:
    """(block_index, first_vector_id, vector_count, data) of vectors (key, v binary) with dense ids."""
    pair = F.struct(F.col(key).alias("id"), F.col("v"))
    blocks = vectors.groupBy(F.floor(F.col(key) / size).cast("int").alias("block_index")).agg(F.array_sort(F.collect_list(pair)).alias("rows"))  # at most `size` rows a group
    data = F.aggregate("rows", F.lit(b""), lambda acc, r: F.concat(acc, r["v"]))
    return blocks.select("block_index", F.col("rows")[0]["id"].alias("first_vector_id"), F.size("rows").alias("vector_count"), data.alias("data"))


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def document_violations(docs: DataFrame) -> DataFrame:
    """docs with `violations`: the rules that a search document breaks; valid rows have an empty array."""
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit("")))
    text = F.coalesce(F.col("chinese_text"), F.lit(""))
    rules = {
        "entry id": F.col("entry_id").isNull() | (size("entry_id") > 128),
        "headword": F.col("headword").isNull() | (F.trim("headword") == "") | (size("headword") > 256),
        "scope": ~F.coalesce(F.col("scope"), F.lit("")).isin(*C.SCOPES),
        "category": (F.col("scope") == "resource") != (F.coalesce(F.col("resource_category"), F.lit("")) != ""),
        "chinese text": (text == "") | ~text.rlike(f"[{X.CJK}]") | (F.octet_length(text) > 16384),
        "weight": F.abs(F.coalesce(F.col("weight"), F.lit(0))) > 1_000_000,
        "section": ~F.coalesce(F.col("section"), F.lit("")).isin(*C.SECTIONS),
        "path": F.size(F.from_json("path_json", "array<string>")) > 32,
    }
    broken = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return docs.withColumn("violations", broken)
