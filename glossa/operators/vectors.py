"""Quantised vector search: normalise, quantise, exact dot products, top k, evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.session import stored, stored_parts

#: Query vectors to a block: all rows are scored against one block after the other, so what is broadcast is bounded.
QUERY_BLOCK = 4096
#: Width of a step in which dot products are counted, and steps on either side of zero.
STEP, EDGES = 64, 256
#: Bits of an entry mask to a group, and bytes of masks that are broadcast at most.
MASK_BITS, BROADCAST_MASKS = 32, 8_000_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def usable(v: Column) -> Column:
    """Neither zero nor with a value that is not finite."""
    return (norm(v) > 0) & ~F.isnan(norm(v)) & (norm(v) < float("inf"))


def quantised_query(v: Column) -> Column:
    """Signed bytes of a query vector: halves are rounded away from zero after normalising."""
    n = norm(v)
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / n * 127, 0).cast("int"))))


def quantised_document(v: Column) -> Column:
    """Signed bytes of a normalised document vector: halves are rounded to even, on single precision."""
    return F.transform(v, lambda x: F.rint(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), (x.cast("float") * F.lit(127).cast("float")).cast("double")))).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x)


def score(d: Column) -> Column:
    """Cosine of two quantised vectors in single precision."""
    return (d / C.DOT_SCALE).cast("float")


def band(s: Column) -> Column:
    """Evidence band of a score; scores of one band count as equal."""
    return F.round(s.cast("double") / C.BAND_WIDTH, 0).cast("int")


def top_matches(queries: DataFrame, vectors: DataFrame, k: int, mask: bool = False, least: float | None = None) -> DataFrame:
    """(query_id, id, dot, place): the k vectors of greatest integer dot product for each query, ties to the smaller id.

    queries: (query_id, q array<int>[, scope_mask]); vectors: (id, v array<int>[, scope_mask]), where with mask=True a vector
    counts only if it shares a bit with the query. The queries are a stated set and go out in blocks of QUERY_BLOCK;
    a first pass counts the dot products of each query in steps, which gives a value that its k-th best reaches, and only what
    reaches it is shuffled. The matches of a block are stored before the next one goes out, so neither a plan nor what the driver
    holds grows with the number of blocks.
    """
    spark = vectors.sparkSession
    scope = ["scope_mask"] * mask
    side = stored(vectors.select("id", "v", *scope), "vectors")
    numbered = stored(queries.select("query_id", "q", *scope), "queries")
    numbered = numbered.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-numbered.count() // QUERY_BLOCK)))))
    blocks = sorted(r["_block"] for r in numbered.select("_block").distinct().collect())
    q_type, id_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    schema = f"query_id {q_type}, id {id_type}, dot int"

    def found(b: int) -> Iterator[DataFrame]:
        part = numbered.filter(F.col("_block") == b).toPandas()
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(), np.stack(part["q"]).astype(np.float32), part["scope_mask"].to_numpy() if mask else None))

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """(number of the first query, ids in order, dot products), -inf where the masks share no bit."""
            names, q, wanted = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                v, ids = np.stack(pdf["v"]).astype(np.float32), pdf["id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                v, ids = v[order], ids[order]
                for a in range(0, len(q), 256):
                    d = q[a : a + 256] @ v.T  # exact: sums of products of bytes stay below 2^24
                    if wanted is not None:
                        d[(wanted[a : a + 256, None] & pdf["scope_mask"].to_numpy()[order][None, :]) == 0] = -np.inf
                    yield a, ids, d

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = shared.value[0]
            total = np.zeros((len(names), 2 * EDGES + 1), dtype=np.int64)
            for a, _, d in scored(batches):
                row, col = np.nonzero(np.isfinite(d))
                edge = np.clip(np.floor(d[row, col] / STEP), -EDGES, EDGES).astype(np.int64) + EDGES
                total[a : a + len(d)] += np.bincount(row * total.shape[1] + edge, minlength=len(d) * total.shape[1]).reshape(len(d), -1)
            above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
            row, edge = np.nonzero((total > 0) & (above - total < k))  # lower ones can't hold the k-th of all
            yield pd.DataFrame({"q": row.astype(np.int32), "edge": (edge - EDGES).astype(np.int32), "n": total[row, edge]})

        upto = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("edge")))
        counted = side.mapInPandas(count, "q int, edge int, n long").groupBy("q", "edge").agg(F.sum("n").alias("n")).withColumn("upto", upto)
        edges = counted.filter(F.col("upto") >= k).groupBy("q").agg(F.max("edge").alias("edge")).toPandas()
        least_dot = np.full(len(part), -np.inf, dtype=np.float32)
        least_dot[edges["q"]] = np.where(edges["edge"] > -EDGES, edges["edge"] * STEP, -np.inf)
        bound = spark.sparkContext.broadcast(least_dot)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = shared.value[0]
            for a, ids, d in scored(batches):
                row, col = np.nonzero(np.isfinite(d) & (d >= bound.value[a : a + len(d), None]))
                yield pd.DataFrame({"query_id": names[a : a + len(d)][row], "id": ids[col], "dot": d[row, col].astype(np.int32)})

        out = side.mapInPandas(scan, schema)
        if least is not None:
            out = out.filter(F.col("dot") / C.DOT_SCALE >= least)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dot"), "id"))
        yield out.withColumn("place", place).filter(F.col("place") <= k)
        shared.destroy()
        bound.destroy()

    parts = (df for b in blocks for df in found(b))
    return stored_parts(spark, parts, f"{schema}, place int", "matches")


def pool_size(offset: int, limit: int) -> int:
    """Vector candidates to gather for a page."""
    return max(192, min(4096, 24 * (offset + limit + 1)))


def evidence_groups(matches: DataFrame, docs: DataFrame, text_id: str, limit: int = 20) -> DataFrame:
    """(query_id, group_place, evidence_place, entry_id, id, dot): matched texts' documents, ranked, grouped by entry, up to eight each.

    docs needs text_id, id, entry_id, headword, weight, role and evidence_role (ranks of the semantic role).
    """
    # The first groups come from the bands that hold the nearest texts, if these name enough entries; only then is the rest of the pool
    # looked into, and of it only what an entry mask lets pass is shuffled by query.
    kept = stored(docs.select(F.col(text_id).alias("_text"), F.col("id"), "entry_id", "headword", "weight", "role", "evidence_role"), "evidence")
    pool = matches.withColumn("band", band(score(F.col("dot"))))
    by = Window.partitionBy("query_id")
    tail = [F.desc("dot"), F.desc(F.coalesce("weight", F.lit(0))), "entry_id", "headword", "id"]
    rows = lambda part: part.select("query_id", F.col("id").alias("_text"), "dot", "band").join(kept, "_text").drop("_text")

    def firsts(part: DataFrame) -> DataFrame:
        """(query_id, entry_id, group_place) of the first groups of the rows of part."""
        placed = rows(part).groupBy("query_id", "entry_id").agg(F.min(F.struct(*_ascending("role"))).alias("_first"))
        return placed.withColumn("group_place", F.row_number().over(by.orderBy("_first"))).filter(F.col("group_place") <= limit).select("query_id", "entry_id", "group_place")

    least = pool.groupBy("query_id").agg(F.min(F.when(F.col("place") <= max(16, limit // 4), F.col("band"))).alias("_least"))
    near = stored(firsts(pool.join(least, "query_id").filter(F.col("band") >= F.col("_least"))), "evidence-near")
    enough = near.filter(F.col("group_place") == limit).select("query_id")
    groups = stored(near.join(enough, "query_id", "left_semi").unionByName(firsts(pool.join(enough, "query_id", "left_anti"))), "evidence-groups")
    words = -(-limit * MASK_BITS // 64)
    slot = F.pmod(F.xxhash64("entry_id"), F.lit(64 * words)).cast("int")
    masks = groups.groupBy("query_id").agg(F.collect_list(slot).alias("slots")).select("query_id", _mask(words)("slots").alias("_mask"))
    there = F.getbit(F.element_at("_mask", (F.floor(slot / 64) + 1).cast("int")), slot % 64) == 1
    if groups.select("query_id").distinct().count() * words * 8 <= BROADCAST_MASKS:
        masks = F.broadcast(masks)
    passed = rows(pool).join(masks, "query_id").filter(there).drop("_mask").join(groups, ["query_id", "entry_id"])
    entry = Window.partitionBy("query_id", "entry_id")
    ranked = passed.withColumn("evidence_place", F.row_number().over(entry.orderBy(F.desc("band"), F.desc("evidence_role"), *tail))).filter(F.col("evidence_place") <= C.EVIDENCE_LIMIT)
    return ranked.select("query_id", "group_place", "evidence_place", "entry_id", "id", "dot")


def _ascending(role: str) -> list[Column]:
    """The order of evidence rows as fields of a struct that is least for the first."""
    return [(-F.col("band")).alias("a"), (-F.col(role)).alias("b"), (-F.col("dot")).alias("c"), (-F.coalesce("weight", F.lit(0)).cast("long")).alias("d"), F.col("entry_id").alias("e"), F.col("headword").alias("f"), F.col("id").alias("g")]


def _mask(words: int):
    """Function of a list of slots: the bits of these slots, in so many words of 64 bits."""

    @F.pandas_udf("array<long>")
    def made(slots: pd.Series) -> pd.Series:
        def of(x: np.ndarray) -> np.ndarray:
            bits = np.zeros(words, dtype=np.uint64)
            x = np.asarray(x, dtype=np.int64)
            np.bitwise_or.at(bits, x // 64, np.uint64(1) << (x % 64).astype(np.uint64))
            return bits.view(np.int64)

        return slots.map(of)

    return made


def merged_matches(matches: DataFrame) -> DataFrame:
    """Up to eight matches of each (query_id, entry_id), with those of one key merged where both sides found the entry.

    matches: (query_id, entry_id, id, key, role, evidence_role, protecting, tier, lexical_at, lexical_place, dot, semantic_at,
    semantic_place), one row per match of a side, the other side's fields null. role and evidence_role are the ranks of the
    semantic role, protecting says whether it can protect a lexical match; *_at is the match's place in its entry.
    Gives (query_id, entry_id, key, strong, dot, answer, lexical_place, semantic_place), strong with the tier of a
    protected lexical match and dot null without a semantic one.
    """
    entry = Window.partitionBy("query_id", "entry_id")
    rows = matches.withColumns({"lexical_place": F.min("lexical_place").over(entry), "semantic_place": F.min("semantic_place").over(entry)})
    both = F.col("lexical_place").isNotNull() & F.col("semantic_place").isNotNull()
    rows = rows.withColumn("_one", F.when(~both, F.struct("id", F.col("dot").isNull().alias("lexical"))))
    is_lexical, is_semantic = F.col("lexical_at").isNotNull(), F.col("semantic_at").isNotNull()
    # lexical matches of one key: the role of the first with the highest evidence rank, in the order of a lexical group
    group = F.struct(
        (-F.col("evidence_role")).alias("a"), (~((F.col("role") >= 2) & (F.col("tier") >= 3))).alias("b"), (~(F.col("protecting") & (F.col("tier") >= 3))).alias("c"),
        (-F.col("tier")).alias("d"), F.col("lexical_at").alias("e"), F.col("protecting").alias("protecting"), F.col("role").alias("role"),
    )
    one = rows.groupBy("query_id", "entry_id", "lexical_place", "semantic_place", "key", "_one").agg(
        F.min(F.when(is_lexical, group)).alias("l"),
        F.min(F.when(is_lexical, F.struct((-F.col("tier")).alias("d"), F.col("lexical_at").alias("e")))).alias("at"),
        F.min(F.when(is_semantic, F.struct("semantic_at", "dot", "role", "evidence_role"))).alias("s"),
    )
    one = one.withColumns({
        "tier": -F.col("at.d"), "dot": F.col("s.dot"), "answer": F.greatest("l.role", "s.role"), "evidence": F.greatest(-F.col("l.a"), F.col("s.evidence_role")),
    })
    one = one.withColumn("strong", F.when(F.col("l.protecting") & (F.col("tier") >= 3), F.col("tier")))
    there = F.col("dot").isNotNull()
    qualified = (F.col("answer") >= 2) & (there | F.coalesce(F.col("tier") >= 3, F.lit(False)))
    order = [
        F.desc(qualified), F.desc_nulls_last("strong"), F.asc_nulls_last(F.when(F.col("strong").isNotNull(), F.col("at.e"))), F.desc(there),
        F.desc(band(score(F.col("dot")))), F.desc(F.when(there, F.col("answer"))), F.desc(F.when(there, F.col("evidence"))), F.desc("dot"), F.when(there, F.col("key")),
        F.desc_nulls_last("tier"), F.asc_nulls_last("at.e"), "key", "s.semantic_at",
    ]
    kept = one.withColumn("_n", F.row_number().over(entry.orderBy(*order))).filter(F.col("_n") <= C.EVIDENCE_LIMIT)
    return kept.select("query_id", "entry_id", "key", "strong", "dot", "answer", "lexical_place", "semantic_place")


def profiled(matches: DataFrame) -> DataFrame:
    """(query_id, entry_id, tier, profile, scores, lexical_place, semantic_place) of merged matches: the evidence an entry is ranked by.

    tier: that of the strongest protected match. profile: array<struct<band,ans,sig,all>> of the semantic matches, best first,
    scores: their dot products in the same order; both null without any. Hits of Latin words are zero.
    """
    there = F.col("dot").isNotNull()
    item = F.struct((-band(score(F.col("dot")))).alias("band"), (-F.col("answer")).alias("ans"), (-F.col("dot")).alias("dot"), "key")
    made = matches.groupBy("query_id", "entry_id", "lexical_place", "semantic_place").agg(F.max("strong").alias("tier"), F.array_sort(F.collect_list(F.when(there, item))).alias("p"))
    quality = F.transform("p", lambda x: F.struct((-x["band"]).alias("band"), (-x["ans"]).alias("ans"), F.lit(0).alias("sig"), F.lit(0).alias("all")))
    some = F.size("p") > 0
    return made.select("query_id", "entry_id", "tier", F.when(some, quality).alias("profile"), F.when(some, F.transform("p", lambda x: -x["dot"])).alias("scores"), "lexical_place", "semantic_place")


def fused(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Lexical and semantic groups of a query brought together by entry and ranked.

    lexical: (query_id, entry_id, tier, place); semantic: (query_id, entry_id, profile, place) with profile an
    array<struct<band,ans,sig,all>>. Strong lexical tiers (3 and more) come first by tier; then entries with semantic
    evidence by their profile, where arrays compare element by element and a longer one wins on an equal beginning.
    """
    both = lexical.withColumnRenamed("place", "lexical_place").join(semantic.withColumnRenamed("place", "semantic_place"), ["query_id", "entry_id"], "full")
    return placed(both.withColumn("scores", F.lit(None).cast("array<int>"))).drop("scores")


def placed(both: DataFrame) -> DataFrame:
    """both (tier, profile, scores, lexical_place, semantic_place by query and entry) with place, in the order of fused(); scores decide between equal profiles."""
    strong = F.when(F.col("tier") >= 3, F.col("tier"))
    order = [
        F.desc(F.coalesce(strong, F.lit(0))), F.when(strong.isNotNull(), F.col("lexical_place")), F.desc(F.col("profile").isNotNull()), F.desc_nulls_last("profile"),
        F.desc_nulls_last("scores"), F.asc_nulls_last("semantic_place"), F.asc_nulls_last("lexical_place"), "entry_id",
    ]
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
