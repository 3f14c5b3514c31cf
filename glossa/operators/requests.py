"""Search requests in a batch: validated, routed to the search that answers them, answered; entries by id with what is attached to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.functions import text as X
from glossa.functions import typo

# Bounds of a request.
LIMIT, REVERSE_LIMIT, OFFSET, QUERY, ENTRY_ID = (20, 50), (32, 256), 511, 200, 512


def scope_mask(scopes: Column) -> Column:
    """Bits of a comma-separated list of scopes; null where it is empty, has spaces or empty parts, or names an unknown scope."""
    parts = F.split(scopes, ",")
    bits = F.transform(parts, lambda s: X.ranked(s, C.SCOPE_BITS, 0))
    return F.when(F.forall(bits, lambda b: b > 0), F.aggregate(bits, F.lit(0), lambda a, b: a.bitwiseOR(b)))


def masked_scopes(mask: Column) -> Column:
    """The scopes of a mask in their order, as text."""
    names = F.array(*(F.when(mask.bitwiseAND(bit) != 0, F.lit(s)) for s, bit in C.SCOPE_BITS.items()))
    return F.array_join(F.filter(names, lambda s: s.isNotNull()), ",")


def _bounded(value: Column, least: int, most: int, default: int) -> Column:
    """A whole number within bounds, the default for none; null for anything else."""
    n = F.when(value.rlike(r"^[+-]?[0-9]{1,9}$"), value.try_cast("int"))
    return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(F.when((n >= least) & (n <= most), n))


def routed(requests: DataFrame) -> DataFrame:
    """(request_id, query, route, error, limit, offset, scopes) of requests (request_id, q, mode, submitted, scope, limit, offset, all strings or null).

    route: reverse or hybrid for queries with a Chinese character, plan for submitted and suggest for other English ones, none where there is nothing to
    search; error names the first thing that is wrong, and then there is no route. Hybrid search needs two Chinese characters.
    """
    query = F.trim(F.coalesce("q", F.lit("")))
    cjk = query.rlike(f"[{X.CJK}]")
    mode, submitted, scope = F.coalesce("mode", F.lit("")), F.coalesce("submitted", F.lit("false")), F.col("scope")
    mask = F.when(scope.isNull(), (1 << len(C.SCOPES)) - 1).otherwise(scope_mask(scope))
    reverse_limit, limit, offset = _bounded(F.col("limit"), 1, REVERSE_LIMIT[1], REVERSE_LIMIT[0]), _bounded(F.col("limit"), 1, LIMIT[1], LIMIT[0]), _bounded(F.col("offset"), 0, OFFSET, 0)
    none = cjk & F.coalesce(scope == "", F.lit(False))
    error = (
        F.when(~mode.isin("", "lexical", "hybrid"), "invalid_mode")
        .when(~submitted.isin("true", "false"), "invalid_submitted")
        .when(query == "", "invalid_query")
        .when(F.length(query) > QUERY, "query_too_long")
        .when(none, None)
        .when(cjk & mask.isNull(), "invalid_scope")
        .when(cjk & reverse_limit.isNull(), "invalid_limit")
        .when(cjk & offset.isNull(), "invalid_offset")
        .when(~cjk & scope.isNotNull(), "invalid_scope")
        .when(~cjk & limit.isNull(), "invalid_limit")
    )
    two = F.size(F.regexp_extract_all(query, F.lit(f"([{X.CJK}])"), F.lit(1))) >= 2
    route = F.when(error.isNotNull(), None).when(none, "none").when(cjk, F.when((mode == "hybrid") & two, "hybrid").otherwise("reverse")).otherwise(F.when(submitted == "true", "plan").otherwise("suggest"))
    good = error.isNull() & ~none
    return requests.select(
        "request_id", query.alias("query"), route.alias("route"), error.alias("error"), F.when(good, F.when(cjk, reverse_limit).otherwise(limit)).alias("limit"),
        F.when(good & cjk, offset).alias("offset"), F.when(good & cjk, masked_scopes(mask)).alias("scopes"),
    )


def suggested(requests: DataFrame, terms: DataFrame, deletes: DataFrame, entries: DataFrame, articles: DataFrame, planned: DataFrame) -> DataFrame:
    """(request_id, place, kind, key, headword, rank) for routed English requests: prefix matches, else corrections, and article terms that no entry has.

    planned: request ids that the planner answers with an exact group or a correction; they get no typing corrections. articles: (term, headword).
    """
    from glossa.operators import lexical

    asked = requests.filter("route in ('suggest', 'plan')").select(F.col("request_id").alias("query_id"), "query", "limit")
    found = lexical.prefix_matches(asked, terms, entries, LIMIT[1])
    without = asked.join(found.select("query_id").distinct(), "query_id", "left_anti").join(planned.select(F.col("request_id").alias("query_id")).distinct(), "query_id", "left_anti")
    typos = lexical.typo_matches(without, terms, deletes, entries, LIMIT[1]).withColumn("rank", F.col("rank") + 2)
    cols = ["query_id", "entry_id", "headword", "rank"]
    main = found.select(*cols).unionByName(typos.select(*cols)).select("query_id", F.lit("dictionary").alias("kind"), F.col("entry_id").alias("key"), "headword", "rank")
    near = _article_prefixes(asked, articles, terms)
    both = main.unionByName(near)
    order = ["rank", *lexical.suggestion_order(F.col("headword"), F.col("key")), "kind"]
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).join(asked.select("query_id", "limit"), "query_id")
    return placed.filter(F.col("place") <= F.col("limit")).select(F.col("query_id").alias("request_id"), "place", "kind", "key", "headword", "rank")


def _article_prefixes(asked: DataFrame, articles: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of articles that begin with a query and that no entry has, exact ones first."""
    spelled = asked.select("query_id", X.straight_apostrophes(F.col("query")).alias("prefix")).filter("prefix <> ''").withColumn("size", F.length("prefix"))
    lone = articles.select("term", "headword").join(terms.select("term").distinct(), "term", "left_anti").groupBy("term").agg(F.min("headword").alias("headword"))
    sizes = F.broadcast(spelled.agg(F.array_sort(F.collect_set("size")).alias("sizes")))  # one row of distinct lengths
    begun = lone.crossJoin(sizes).select("term", "headword", F.explode(F.filter("sizes", lambda n: n <= F.length("term"))).alias("size")).withColumn("prefix", F.substring("term", F.lit(1), F.col("size")))
    met = spelled.join(begun, ["prefix", "size"]).withColumn("rank", F.when(F.col("term") == F.col("prefix"), 0).otherwise(1))
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", F.length("term"), X.ascii_lower(F.col("headword")), "term"))).filter(F.col("_n") <= LIMIT[1])
    return first.select("query_id", F.lit("etymology").alias("kind"), F.col("term").alias("key"), "headword", "rank")


def entries_by_id(ids: DataFrame, entries: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, status, entry columns, articles) for each asked id: ok, invalid_id or entry_not_found, with the articles of its headword in order.

    entries: (id, headword, ...); articles: (term, id, label, preview, position). At most 64 articles of a term are gathered.
    """
    valid = F.coalesce((F.col("id") != "") & (F.octet_length("id") <= ENTRY_ID), F.lit(False))
    asked = ids.select("id").distinct()
    found = asked.join(entries.withColumn("_there", F.lit(True)), "id", "left")
    status = F.when(~valid, "invalid_id").when(F.col("_there").isNull(), "entry_not_found").otherwise("ok")
    first = articles.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy("position", "id"))).filter("_n <= 64")
    summary = first.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id", "label", "preview"))), lambda a: F.struct(a["id"].alias("id"), a["label"].alias("label"), a["preview"].alias("preview"))).alias("articles"))
    keyed = found.withColumns({"status": status, "term": X.straight_apostrophes(F.col("headword"))}).drop("_there")
    return keyed.join(summary, "term", "left").drop("term")


def article_typos(queries: DataFrame, terms: DataFrame, limit: int = 20, most: int = C.TYPO_LIMIT) -> DataFrame:
    """(query_id, term, headword, rank, place): article terms one edit away from a query, direct candidates first, then signature by signature in order of term.

    terms: (term, headword). At most `most` terms are considered.
    """
    wanted = queries.select("query_id", X.straight_apostrophes(F.col("query")).alias("q")).filter(typo.eligible(F.col("q")))
    known = terms.groupBy("term").agg(F.min("headword").alias("headword"))
    shift = F.size(typo.direct_candidates(F.col("q")))
    direct = wanted.select("query_id", F.posexplode(typo.direct_candidates(F.col("q"))).alias("rank", "term")).join(known.select("term"), "term")
    index = known.filter(typo.eligible(F.col("term"))).select(F.explode(typo.deletes(F.col("term"))).alias("signature"), "term").distinct()
    probes = wanted.select("query_id", shift.alias("shift"), F.posexplode(typo.signatures(F.col("q"))).alias("at", "signature"))
    near = probes.join(index, "signature").select("query_id", "term", (F.col("shift") + F.col("at")).alias("rank"))
    best = direct.select("query_id", "term", "rank").unionByName(near).groupBy("query_id", "term").agg(F.min("rank").alias("rank"))
    considered = best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "term"))).filter(F.col("_n") <= most).drop("_n")
    named = considered.join(known, "term")
    order = ["rank", X.ascii_lower(F.col("headword")), "term"]
    return named.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("place") <= limit)


def headword_forms(docs: DataFrame, *forms: str) -> DataFrame:
    """(entry_id, form): the distinct spellings of an entry, its headword and the array columns `forms`; null and blank ones are left out."""
    every = F.concat(F.array("headword"), *(F.coalesce(f, F.array().cast("array<string>")) for f in forms))
    return docs.filter("entry_id is not null").select("entry_id", F.explode(every).alias("form")).filter("trim(form) <> ''").distinct()


def forms_of(ids: DataFrame, forms: DataFrame) -> DataFrame:
    """(entry_id, forms) of the asked ids (entry_id) that have any, in order."""
    return forms.join(ids.select("entry_id").distinct(), "entry_id", "left_semi").groupBy("entry_id").agg(F.array_sort(F.collect_set("form")).alias("forms"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table: the same whatever the order and partitions of its rows, another where a row is changed, added or repeated.

    Each row's SHA-256 is summed in eight parts of 32 bits, so copies count; the digest is that of the sums.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    sums = df.select(row.alias("_d")).agg(F.count("*").alias("rows"), *parts)
    return sums.select("rows", F.sha2(F.concat_ws("-", *(F.coalesce(f"s{i}", F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(8))).cast("binary"), 256).alias("digest"))
