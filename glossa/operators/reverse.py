"""Reverse search: Chinese and mixed queries to documents by shared characters, ranked by how the query sits in the text.

All queries are answered together: the tokens they share with documents are counted over shelves of documents, or within those of a rare word
(see pools). Documents with every token come first, with those of which a segment is the query; only pool tiers that have none of
them left after the filters are searched for any token. English words in a query name headwords, whose documents
are anchors: they come before all others and pass the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.functions import text as X
from glossa.operators.pools import Pools, by_word
from glossa.session import stored


def prepared_queries(queries: DataFrame, normal=lambda v: v) -> DataFrame:
    """(query_id, q, n_runs, tokens, n_tokens, words, anchors) of the queries with a Chinese character or an English word; q joins the runs.

    normal: compatibility normalisation of a column, for queries that haven't had it.
    """
    text = F.col("_text")
    runs = X.cjk_runs(X.spaced(text))
    made = queries.withColumn("_text", normal(F.col("query"))).select("query_id", runs.alias("q_runs"), F.array_distinct(X.filter_tokens(text)).alias("words"), X.anchor_terms(text).alias("anchors"))
    made = made.filter((F.size("q_runs") > 0) | (F.size("words") > 0))
    full = made.select("query_id", F.array_join("q_runs", "").alias("q"), F.size("q_runs").alias("n_runs"), X.query_tokens(F.col("q_runs")).alias("tokens"), "words", "anchors")
    return full.withColumn("n_tokens", F.size("tokens"))


def prepared_documents(docs: DataFrame, normal=lambda v: v) -> DataFrame:
    """docs with the Chinese runs of their text, what is measured on a text alone, and their ranks by scope and role."""
    held, outside = X.bracket_views(F.col("_text"))
    docs = docs.withColumn("_text", normal(F.coalesce("chinese_text", F.lit("")))).withColumns(
        {
            "runs": X.cjk_runs(X.spaced(F.col("_text"))),
            "pool": X.ranked(F.col("scope"), C.POOL_TIER, 0),
            "priority": X.ranked(F.col("scope"), C.RESULT_PRIORITY),
            "role": X.ranked(F.col("semantic_role"), C.RETRIEVAL_ROLE),
            "evidence_role": X.ranked(F.col("semantic_role"), C.EVIDENCE_ROLE),
        }
    )
    alone = {
        "held": held,
        "outside": outside,
        "total": F.aggregate("runs", F.lit(0), lambda a, r: a + F.length(r)),
        "negated": F.filter("runs", X.has_negation),
        "affirmed": F.filter("runs", lambda r: ~X.has_negation(r)),
    }
    return docs.withColumns(alone).drop("_text").filter(F.size("runs") > 0)


def candidates(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id, pool, shared, every): documents with any token of a query, how many they share, and whether that is all.

    queries: prepared_queries(); docs: prepared_documents(). The postings are cut down to tokens that a query has before they are grouped.
    """
    asked = queries.select("query_id", "n_tokens", F.explode("tokens").alias("token"))
    kept = ["id", "pool", *(c for c in ("weight", "entry_id") if c in docs.columns)]  # what pools are cut by goes along, so no pair is joined for it
    postings = docs.select(*kept, F.explode(X.index_tokens(F.col("runs"))).alias("token"))
    met = postings.join(asked, "token").groupBy("query_id", *kept, "n_tokens").agg(F.count("*").cast("int").alias("shared"))
    return met.select("query_id", *kept, "shared", (F.col("shared") == F.col("n_tokens")).alias("every"))


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (q, weight and the columns of prepared_documents()) with score, tier and the measures behind them."""
    q, runs = F.col("q"), F.col("runs")
    n = F.length(q)
    held = F.col("contains")  # then the other measures are known
    out = pairs.withColumn("contains", (n > 0) & F.exists(runs, lambda r: F.contains(r, q))).withColumns(
        {
            "longest": F.when(held, n).otherwise(X.longest_common(q, runs)),
            "coverage": F.when(held, 1.0).otherwise(X.bigram_coverage(q, runs)),
            "leading": F.when(held, 1.0).otherwise(X.leading_coverage(q, runs)),
            "quality": X.segment_quality(q, runs),
            "bracket_only": (n > 0) & F.contains("held", q) & ~F.contains("outside", q),
            "same": F.when(X.has_negation(q), F.col("negated")).otherwise(F.col("affirmed")),
        }
    )
    # where no run is left out the longest part is held by one of them
    out = out.withColumn("negation", F.when(F.size("same") == F.size(runs), False).otherwise((F.col("longest") > 0) & ~X.holds_part(q, F.col("same"), F.col("longest"))))
    least_run = F.greatest(F.lit(3), F.floor((n + 1) / 2).cast("int"))
    spread = (n >= 4) & ~F.col("negation") & (F.col("coverage") >= 0.6) & (F.col("longest") >= least_run)
    tier = F.when(F.col("quality.exact") & ~F.col("bracket_only"), 4).when(F.col("quality.extension"), 3).when(F.col("quality.boundary") | F.col("contains") | spread, 2).otherwise(1)
    score = (
        F.coalesce(F.col("weight"), F.lit(0))
        + C.COMPACTNESS * F.col("quality.compactness")
        + C.OVERALL * n / F.col("total")
        + C.POSITION * F.col("quality.position")
        + C.LEADING * F.col("leading")
        + C.COVERAGE * F.col("coverage")
        + C.RUN * F.col("longest")
        - F.when(F.col("bracket_only"), C.BRACKET).otherwise(0)
        - F.when(F.col("negation"), C.NEGATION).otherwise(0)
    )
    some, weight = n > 0, F.coalesce(F.col("weight"), F.lit(0)).cast("double")  # a query without Chinese characters is scored by weight alone
    return out.withColumns({"tier": F.when(some, tier).otherwise(0), "score": F.when(some, score.cast("double")).otherwise(weight), "strong": (F.col("contains")) | (~F.col("negation") & (F.col("coverage") >= 0.6) & (F.col("longest") >= least_run))})


def length_filtered(rows: DataFrame) -> DataFrame:
    """Rows that fit the length of their query; anchors always do.

    One character: no examples. Two or three: a shared run of two. Four and more: what contains the query or covers it well;
    for queries without any such row or anchor, the rows of the longest shared run that is long enough.
    """
    n = F.length("q")
    by = Window.partitionBy("query_id")
    strong = F.col("strong") | F.col("anchor")
    some = F.max(strong.cast("int")).over(by) == 1
    best = F.max(F.when(~F.col("negation"), F.col("longest"))).over(by)
    least = F.greatest(F.lit(3), F.floor((n + 1) / 2).cast("int"))
    marked = rows.withColumns({"_some": some, "_best": best})
    long = F.when(F.col("_some"), strong).otherwise(~F.col("negation") & (F.col("longest") == F.col("_best")) & (F.col("longest") >= least))
    keep = F.when(F.col("anchor") | (n == 0), True).when(n == 1, F.col("scope") != "example").when(n <= 3, F.col("longest") >= 2).otherwise(long)
    return marked.filter(keep).drop("_some", "_best")


def pooled(met: DataFrame, limit: int = C.TIER_LIMIT, by: str = "query_id") -> DataFrame:
    """The heaviest rows of each query and pool tier."""
    place = F.row_number().over(Window.partitionBy(by, "pool").orderBy(F.desc(F.coalesce("weight", F.lit(0))), "entry_id", "id"))
    return met.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")


def anchored(asked: DataFrame, docs: DataFrame, names: DataFrame, limit: int = C.TIER_LIMIT) -> DataFrame:
    """(query_id, id, anchor_rank): documents of entries that a query names.

    names: (term, entry_id), the terms of the entries' headwords and forms. An entry counts with the first term that names it, the first `limit` entries of a
    query with a document and then its first `limit` documents.
    """
    terms = asked.select("query_id", F.posexplode("anchors").alias("ordinal", "term"))
    entries = terms.join(names.distinct(), "term").groupBy("query_id", "entry_id").agg(F.min("ordinal").alias("anchor_rank"))
    entries = entries.join(docs.select("entry_id").distinct(), "entry_id", "left_semi")
    first = entries.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("anchor_rank", "entry_id"))).filter(F.col("_n") <= limit).drop("_n")
    rows = first.join(docs.select("id", "entry_id", "weight"), "entry_id")
    order = ["anchor_rank", F.desc(F.coalesce("weight", F.lit(0))), "entry_id", "id"]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_n") <= limit).select("query_id", "id", "anchor_rank")


#: Queries are broadcast up to so many (of at most 200 characters, some 20 MB), else joined by shuffle.
BROADCAST_QUERIES = 20_000
TEXTS = ("headword", "english_text", "candidate_text", "definition_text", "chinese_text")
#: What a measured pair is filtered and ranked by.
MEASURED = ("q", "scope", "entry_id", "headword", "chinese_text", "priority", "evidence_role", "longest", "negation", "strong", "tier", "score", "hits", "anchor")


def search(queries: DataFrame, docs: DataFrame, limit: int = 32, names: DataFrame | None = None, normal=lambda v: v) -> DataFrame:
    """(query_id, group_place, evidence_place, entry_id, id, tier, score): ranked groups with up to eight documents each.

    docs: (id, entry_id, headword, scope, semantic_role, chinese_text, weight) and, where there are, the other texts. names: (term, entry_id) for anchors,
    by default the terms of the documents' headwords. Null weights count as 0; documents without an entry or a Chinese character take no part.
    """
    n, pairs = F.length("q"), F.size(F.filter("tokens", lambda t: F.length(t) == 2))
    # what the length filter keeps of a query of four characters or more has a run of half of it in common, so it shares the pairs of that run, repeated ones aside;
    # a pair that shares fewer is dropped once the pool is cut, before anything is measured
    least = F.when(n >= 4, F.greatest(F.lit(3), F.floor((n + 1) / 2).cast("int")) - 1 - (n - 1 - pairs)).otherwise(0)
    asked = stored(prepared_queries(queries, normal).withColumn("least", least), "reverse-queries")
    few = asked.count() <= BROADCAST_QUERIES
    sent = lambda df: F.broadcast(df) if few else df
    fields = docs.withColumns({f: F.lit(None).cast("string") for f in TEXTS if f not in docs.columns}).filter("entry_id is not null")
    there = stored(prepared_documents(fields.select("id", "entry_id", "scope", "semantic_role", "weight", *TEXTS), normal), "reverse-documents")
    by_tokens = asked.select("query_id", "tokens", "words", "least")
    named, rare = by_word(by_tokens.filter("size(words) > 0"), there, C.TIER_LIMIT)
    pools = Pools(by_tokens.join(rare, "query_id", "left_anti"), there, C.TIER_LIMIT)
    whole = asked.filter("n_tokens > 1").select("query_id")
    cols = ["query_id", "id", "pool"]
    segments = there.select("id", "pool", "weight", "entry_id", F.explode(F.array_distinct("runs")).alias("segment")).filter(F.length("segment") <= C.SEGMENT_LENGTH)
    # many queries have one segment: its pools are cut once
    by_segment = asked.filter("n_runs = 1").select("query_id", F.col("q").alias("segment"))
    wanted = stored(by_segment.select("segment").distinct(), "reverse-segments")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_QUERIES else wanted
    exact = pooled(segments.join(wanted, "segment"), by="segment").join(by_segment, "segment").select(*cols)

    rows = there.select("id", "scope", "weight", "runs", "priority", "role", "evidence_role", "entry_id", "held", "outside", "total", "negated", "affirmed", *TEXTS)
    asked_by = asked.select("query_id", "q", "words", "n_tokens")
    # a pair is few bytes but much work: a number of partitions that is given isn't coalesced by size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    detailed = lambda pairs: scored(pairs.join(sent(asked_by), "query_id").repartition(parts, "id").join(rows, "id"))
    no_hits = F.struct(F.lit(0).alias("significant"), F.lit(0).alias("all"))
    marked = lambda found: found.withColumns({"hits": F.when(F.size("words") > 0, X.evidence_hits(F.col("words"), *map(F.col, TEXTS))).otherwise(no_hits), "anchor": F.col("anchor_rank").isNotNull()})
    words = lambda found: found.filter(F.col("anchor") | (F.col("hits.all") == F.size("words")))
    measured = lambda pairs: words(marked(detailed(pairs))).select(*cols, "anchor_rank", *MEASURED)
    none = F.lit(None).cast("int")
    precise = pools.whole().unionByName(named.filter("n > 1 and shared = n").select(*cols)).unionByName(exact.join(whole, "query_id", "left_semi")).distinct().withColumn("anchor_rank", none)
    first = stored(length_filtered(measured(precise)), "reverse-precise")
    satisfied = first.select("query_id", "pool").distinct()
    # queries of one token have no pass of their own for whole matches, their exact segments join here
    single = exact.join(whole, "query_id", "left_anti")
    near = named.filter("shared >= least").select(*cols).unionByName(single).join(satisfied, ["query_id", "pool"], "left_anti")
    rest = pools.near(satisfied.join(rare, "query_id", "left_anti")).unionByName(near).distinct()
    names = there.select(X.headword_term(F.col("headword")).alias("term"), "entry_id").filter("term <> ''") if names is None else names
    anchors = stored(anchored(asked, there, names).join(there.select("id", "pool"), "id"), "reverse-anchors")
    united = rest.withColumn("anchor_rank", none).unionByName(anchors.select(*cols, "anchor_rank"))
    united = united.groupBy(*cols).agg(F.min("anchor_rank").alias("anchor_rank")).join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")  # signals of one document merge
    # what the precise pass measured isn't measured again, it only may be an anchor too
    again = first.drop("anchor_rank", "anchor").join(anchors.select("query_id", "id", "anchor_rank"), ["query_id", "id"], "left").withColumn("anchor", F.col("anchor_rank").isNotNull())
    return grouped(length_filtered(again.unionByName(measured(united))), limit)


def grouped(rows: DataFrame, limit: int) -> DataFrame:
    """Rows ranked, then gathered by entry in the order of each entry's first row."""
    kind = ["query_id", "entry_id", "tier", "priority", "evidence_role"]
    support = F.least(F.size(F.collect_set("chinese_text").over(Window.partitionBy(*kind))), F.lit(C.CORROBORATION_LIMIT))
    rows = rows.withColumn("support", support)
    high, anchor = F.col("tier") > 1, F.col("anchor")
    named = [F.desc("tier"), F.desc(F.when(anchor, F.col("hits.significant"))), F.desc(F.when(anchor, F.col("hits.all"))), F.desc(F.when(anchor, F.col("score"))), F.when(anchor, F.col("anchor_rank"))]
    order = [
        F.desc("anchor"), *named, F.desc("pool"), F.desc(F.when(high, F.col("priority"))), F.desc(F.when(high, F.col("evidence_role"))), F.desc(F.when(high, F.col("support"))),
        F.desc("score"), F.desc("priority"), F.desc("evidence_role"), F.desc("support"), "entry_id", "headword", "id",
    ]
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    entry = Window.partitionBy("query_id", "entry_id")
    placed = placed.withColumns({"_first": F.min("place").over(entry), "evidence_place": F.row_number().over(entry.orderBy("place"))}).filter(F.col("evidence_place") <= C.EVIDENCE_LIMIT)
    ranked = placed.withColumn("group_place", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))).filter(F.col("group_place") <= limit)
    return ranked.select("query_id", "group_place", "evidence_place", "entry_id", "id", "tier", F.round("score", 6).alias("score"))
