"""Chinese indexes over the search documents, and reverse search with the entries' translations as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import index, reverse
from glossa.session import table

CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}"
SPACED = r"trim(regexp_replace(translate(%s, '矽', '硅'), '[\s\pZ\pP\pS]+', ' ', 'g'))"
RUNS = f"regexp_extract_all({SPACED}, '[{CJK}]+')"
DOCS = f"docs AS (SELECT DISTINCT id, entry_id, scope, {RUNS % 'chinese_text'} AS runs FROM search_documents WHERE id IS NOT NULL AND chinese_text IS NOT NULL)"
POOL = "CASE WHEN scope IN ('sense', 'phrase', 'form') THEN 3 WHEN scope = 'resource' THEN 2 WHEN scope = 'example' THEN 1 ELSE 0 END"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Search documents, redelivered rows once."""
    return table(spark, sf, "search_documents").drop("imported_at").distinct().filter("id is not null")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    previews = table(spark, sf, "entries").select(F.col("translation_preview").alias("query")).filter("query is not null").distinct()
    return previews.select(F.col("query").alias("query_id"), "query")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("id", X.cjk_runs(X.spaced(F.col("chinese_text"))).alias("runs")).filter("runs is not null")


def posting_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by token: the size of each posting list."""
    return index.postings(_runs(spark, sf), "id", F.col("runs")).groupBy("token").agg(F.count("*").alias("documents"))


def exact_segments(spark: SparkSession, sf: str) -> DataFrame:
    return index.exact_segments(_runs(spark, sf), "id", F.col("runs"))


def reverse_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """By query and pool tier: documents with any and with every token of the query."""
    met = reverse.candidates(reverse.prepared_queries(_queries(spark, sf)), reverse.prepared_documents(_docs(spark, sf)))
    return met.groupBy("query_id", "pool").agg(F.count("*").alias("some"), F.sum(F.col("every").cast("long")).alias("every"))


def segment_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which a whole segment is the query, for every first Chinese run of a text as a query."""
    runs = X.cjk_runs(X.spaced(F.col("normalized_chinese_text")))
    asked = table(spark, sf, "texts").select(F.try_element_at(runs, F.lit(1)).alias("query")).filter("query is not null").distinct()
    wanted = reverse.prepared_queries(asked.select(F.col("query").alias("query_id"), "query")).filter("n_runs = 1").select("query_id", F.col("q").alias("segment"))
    return index.exact_segments(_runs(spark, sf), "id", F.col("runs")).join(wanted, "segment").select("query_id", "id")


def match_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of every query within the documents of its own entry."""
    asked = table(spark, sf, "entries").select(F.col("id").alias("entry_id"), F.array_join(X.cjk_runs(X.spaced(F.col("translation_preview"))), "").alias("q")).filter("q <> ''").distinct()
    docs = _docs(spark, sf).select("id", "entry_id", X.cjk_runs(X.spaced(F.col("chinese_text"))).alias("runs")).filter("size(runs) > 0")
    both = docs.join(asked, "entry_id")
    q, runs = F.col("q"), F.col("runs")
    found = both.select(
        "id", "q", F.exists(runs, lambda r: F.contains(r, q)).alias("contains"), X.longest_common(q, runs).alias("longest"), F.round(X.bigram_coverage(q, runs), 6).alias("coverage"),
        F.round(X.leading_coverage(q, runs), 6).alias("leading"), X.has_negation(q).alias("negation"), X.segment_quality(q, runs).alias("s"),
    )
    return found.select("id", "q", "contains", "longest", "coverage", "leading", "negation", F.col("s.exact").alias("exact"), F.round("s.compactness", 6).alias("compactness"), F.round("s.position", 6).alias("position"))


def reverse_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every translation preview, and every headword with its preview as a mixed query, against all documents; an entry without both has no mixed query."""
    mixed = table(spark, sf, "entries").filter("headword is not null and translation_preview is not null").select(F.concat_ws(" ", "headword", "translation_preview").alias("query"))
    asked = _queries(spark, sf).unionByName(mixed.select(F.col("query").alias("query_id"), "query")).distinct()
    return reverse.search(asked, _docs(spark, sf), normal=X.compatible)


def document_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the rules they break."""
    broken = index.document_violations(_docs(spark, sf)).select(F.explode("violations").alias("violation"))
    return broken.groupBy("violation").agg(F.count("*").alias("documents"))


def corpus_texts(spark: SparkSession, sf: str) -> DataFrame:
    return index.corpus_texts(_docs(spark, sf), X.spaced(F.col("chinese_text")), F.col("scope"))


def text_sample(spark: SparkSession, sf: str) -> DataFrame:
    return index.hashed_sample(table(spark, sf, "texts"), "normalized_chinese_text", "glossa-1", 200)


def entry_stride(spark: SparkSession, sf: str) -> DataFrame:
    return index.stride_sample(table(spark, sf, "entries").select("id"), "id").select("id", "ordinal")


def vector_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """How many document texts have a vector already."""
    texts = table(spark, sf, "search_documents").select(F.col("chinese_text").alias("text")).filter("text is not null").distinct()
    earlier = table(spark, sf, "texts").select(F.col("normalized_chinese_text").alias("text"))
    reused, new = index.reusable(texts, earlier, "text")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("texts"))
    return count(reused, "reused").unionByName(count(new, "new"))


_TOKENS = """SELECT DISTINCT id, unnest(list_concat(flatten([[substr(r, i, 1) FOR i IN range(1, length(r) + 1)] FOR r IN runs]), flatten([[substr(r, i, 2) FOR i IN range(1, length(r))] FOR r IN runs]))) AS token FROM docs"""
_ASKED = f"""asked AS (SELECT query_id, q_runs, array_to_string(q_runs, '') AS q FROM (SELECT DISTINCT translation_preview AS query_id, {RUNS % 'translation_preview'} AS q_runs FROM entries WHERE translation_preview IS NOT NULL) WHERE len(q_runs) > 0)"""
_QTOKENS = "qtokens AS (SELECT DISTINCT query_id, unnest(flatten([CASE WHEN length(r) = 1 THEN [r] ELSE [substr(r, i, 2) FOR i IN range(1, length(r))] END FOR r IN q_runs])) AS token FROM asked)"

QUERIES = {
    "posting_sizes": posting_sizes,
    "exact_segments": exact_segments,
    "reverse_candidates": reverse_candidates,
    "segment_matches": segment_matches,
    "match_quality": match_quality,
    "reverse_search": reverse_search,
    "document_validation": document_validation,
    "corpus_texts": corpus_texts,
    "text_sample": text_sample,
    "entry_stride": entry_stride,
    "vector_reuse": vector_reuse,
}
ORACLE = {
    "posting_sizes": f"WITH {DOCS} SELECT token, count(*) AS documents FROM ({_TOKENS}) GROUP BY token",
    "exact_segments": f"WITH {DOCS} SELECT DISTINCT segment, id FROM (SELECT id, unnest(runs) AS segment FROM docs) WHERE length(segment) <= 200",
    "reverse_candidates": f"""WITH {DOCS}, {_ASKED}, {_QTOKENS}, tokens AS ({_TOKENS}),
        met AS (SELECT query_id, id, count(*) AS shared FROM qtokens JOIN tokens USING (token) GROUP BY 1, 2)
        SELECT query_id, pool, count(*) AS some, sum(CASE WHEN shared = n THEN 1 ELSE 0 END)::BIGINT AS every
        FROM met JOIN (SELECT DISTINCT id, {POOL} AS pool FROM docs) USING (id) JOIN (SELECT query_id, count(*) AS n FROM qtokens GROUP BY 1) USING (query_id) GROUP BY 1, 2""",
    "segment_matches": f"""WITH {DOCS}, asked AS (SELECT DISTINCT ({RUNS % 'normalized_chinese_text'})[1] AS query_id FROM texts)
        SELECT DISTINCT query_id, id FROM (SELECT id, unnest(runs) AS query_id FROM docs) JOIN asked USING (query_id) WHERE length(query_id) <= 200""",
    "match_quality": f"""WITH {DOCS}, own AS (SELECT DISTINCT id AS entry_id, array_to_string({RUNS % 'translation_preview'}, '') AS q FROM entries WHERE translation_preview IS NOT NULL),
        both_ AS (SELECT DISTINCT d.id, q, runs, length(q) AS n FROM docs d JOIN own USING (entry_id) WHERE q <> '' AND len(runs) > 0)
        SELECT id, q, list_bool_or([contains(r, q) FOR r IN runs]) AS contains,
          coalesce(list_max([length(s) FOR s IN flatten([[substr(q, i, k) FOR k IN range(1, n - i + 2)] FOR i IN range(1, n + 1)]) IF list_bool_or([contains(r, s) FOR r IN runs])]), 0)::INT AS longest,
          round(CASE WHEN n >= 2 THEN len([1 FOR i IN range(1, n) IF list_bool_or([contains(r, substr(q, i, 2)) FOR r IN runs])]) / (n - 1) WHEN list_bool_or([contains(r, q) FOR r IN runs]) THEN 1 ELSE 0 END, 6) AS coverage,
          round(coalesce(list_max([k FOR k IN range(1, n + 1) IF list_bool_or([contains(r, substr(q, 1, k)) FOR r IN runs])]), 0) / n, 6) AS leading,
          regexp_matches(q, '[不没无未非莫别勿]|难[以于]') AS negation, list_contains(runs, q) AS exact,
          round(coalesce(list_max([n / length(r) FOR r IN runs IF contains(r, q)]), 0), 6) AS compactness,
          round(coalesce(list_max([1 / i FOR i IN range(1, len(runs) + 1) IF contains(runs[i], q)]), 0), 6) AS position FROM both_""",
    "document_validation": f"""WITH d AS (SELECT DISTINCT * EXCLUDE (imported_at) FROM search_documents WHERE id IS NOT NULL), v AS (SELECT unnest(list_filter([
          CASE WHEN entry_id IS NULL OR strlen(entry_id) > 128 THEN 'entry id' END, CASE WHEN headword IS NULL OR trim(headword) = '' OR strlen(headword) > 256 THEN 'headword' END,
          CASE WHEN coalesce(scope, '') NOT IN ('sense', 'phrase', 'form', 'example', 'resource') THEN 'scope' END,
          CASE WHEN (scope = 'resource') <> (coalesce(resource_category, '') <> '') THEN 'category' END,
          CASE WHEN coalesce(chinese_text, '') = '' OR NOT regexp_matches(chinese_text, '[{CJK}]') OR strlen(chinese_text) > 16384 THEN 'chinese text' END,
          CASE WHEN abs(coalesce(weight, 0)) > 1000000 THEN 'weight' END,
          CASE WHEN coalesce(section, '') NOT IN ('definitions', 'idioms', 'phrasal-verbs', 'derived-forms', 'grammar-usage') THEN 'section' END,
          CASE WHEN json_array_length(path_json) > 32 THEN 'path' END], lambda x: x IS NOT NULL)) AS violation FROM d) SELECT violation, count(*) AS documents FROM v GROUP BY 1""",
    "corpus_texts": f"""WITH t AS (SELECT {SPACED % 'chinese_text'} AS normalized, CASE scope WHEN 'sense' THEN 1 WHEN 'phrase' THEN 2 WHEN 'form' THEN 4 WHEN 'example' THEN 8 WHEN 'resource' THEN 16 ELSE 0 END AS bit
          FROM (SELECT DISTINCT * EXCLUDE (imported_at) FROM search_documents WHERE id IS NOT NULL))
        SELECT normalized, bit_or(bit) AS scope_mask, count(*) AS documents, row_number() OVER (ORDER BY normalized) - 1 AS id FROM t WHERE normalized <> '' GROUP BY normalized""",
    "text_sample": "SELECT normalized_chinese_text FROM (SELECT DISTINCT normalized_chinese_text FROM texts) ORDER BY sha256('glossa-1' || chr(0) || normalized_chinese_text), 1 LIMIT 200",
    "entry_stride": "SELECT id, ordinal FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ordinal, greatest(1, ceil(count(*) OVER () / 256))::BIGINT AS step FROM entries) WHERE ordinal % step = 0",
    "vector_reuse": """WITH t AS (SELECT DISTINCT chinese_text AS text FROM search_documents WHERE chinese_text IS NOT NULL), e AS (SELECT normalized_chinese_text AS text FROM texts GROUP BY 1 HAVING count(*) = 1)
        SELECT 'reused' AS kind, count(*) AS texts FROM t SEMI JOIN e USING (text) UNION ALL SELECT 'new', count(*) FROM t ANTI JOIN e USING (text)""",
}
