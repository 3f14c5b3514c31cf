"""Requests answered in a batch, entries by id, article terms one edit away, forms of headwords, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import english, index, requests
from glossa.plans.lexical_queries import DELETES, FOLD, TERMS, _SWAPPED, _misspelt, _terms
from glossa.plans.reverse_queries import CJK
from glossa.session import stored, table


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each case, with parameters by its query's length; every kind of fault occurs."""
    n = F.length(F.coalesce("query", F.lit("")))
    pick = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (n % by + 1).cast("int"))
    c = table(spark, sf, "threshold_cases").select("id", "query").distinct()
    english_ = table(spark, sf, "entries").select(F.concat(F.lit("en-"), "id").alias("id"), F.lower(F.substring("headword", 1, 5)).alias("query"))
    return c.unionByName(english_).select(
        F.col("id").alias("request_id"), F.col("query").alias("q"), pick(4, None, "hybrid", "lexical", "hybrid").alias("mode"), pick(3, None, "true", "false").alias("submitted"),
        F.when(F.col("id").startswith("en-"), None).otherwise(pick(6, None, "sense,example", "sense", "", "phrase,,form", "unknown")).alias("scope"),
        pick(5, None, "7", "0", "50", "x").alias("limit"), pick(7, None, "3", "511", "512", "-1", "0", "9").alias("offset"),
    )


def request_routes(spark: SparkSession, sf: str) -> DataFrame:
    return requests.routed(_requests(spark, sf))


def request_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The answers to the English requests among them."""
    terms, entries = _terms(spark, sf), table(spark, sf, "entries").select("id", "headword")
    articles = table(spark, sf, "etymology_articles").select(F.col("term_normalized").alias("term"), F.col("term_normalized").alias("headword")).filter("term is not null").distinct()
    asked = stored(request_routes(spark, sf).filter("route in ('suggest', 'plan')"), "requests")
    plan = english.plan(asked.filter("route = 'plan'").select(F.col("request_id").alias("query_id"), "query"), terms)
    planned = plan.filter("kind in ('exact', 'correction')").select(F.col("query_id").alias("request_id")).distinct()
    return requests.suggested(asked, terms, index.term_deletes(terms), entries, articles, planned)


def entry_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry that a document or article names, with the number of its articles and the first of them."""
    ids = table(spark, sf, "search_documents").select(F.col("entry_id").alias("id")).unionByName(table(spark, sf, "etymology_articles").select(F.concat("entry_id", F.lit("x")).alias("id"))).filter("id is not null")
    articles = index.first_per(table(spark, sf, "etymology_articles").filter("term_normalized is not null"), ["id"], F.desc("imported_at"), "position_no")
    found = requests.entries_by_id(ids, table(spark, sf, "entries").select("id", "headword"), articles.select(F.col("term_normalized").alias("term"), "id", "label", "preview", F.col("position_no").alias("position")))
    return found.select("id", "status", "headword", F.coalesce(F.size("articles"), F.lit(0)).alias("articles"), F.try_element_at("articles", F.lit(1))["id"].alias("first_article"))


def article_typos(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "etymology_articles").select(F.col("term_normalized").alias("term"), F.col("term_normalized").alias("headword")).filter("term is not null")
    return requests.article_typos(_misspelt(spark, sf), terms).select("query_id", "term", "rank", "place")


def headword_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of every entry with an article."""
    forms = requests.headword_forms(table(spark, sf, "search_documents"))
    found = requests.forms_of(table(spark, sf, "etymology_articles").select("entry_id"), forms)
    return found.select("entry_id", F.size("forms").alias("n"), F.array_join("forms", "|").alias("forms"))


def headword_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The terms by which entries are anchored."""
    forms = requests.headword_forms(table(spark, sf, "search_documents"))
    return forms.select(X.headword_term(F.col("form")).alias("term"), "entry_id").filter("term <> ''").distinct()


def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return requests.fingerprint(table(spark, sf, "texts"))


_PICK = lambda by, *values: f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[n % {by} + 1]"
_ROUTES = f"""r0 AS (SELECT DISTINCT id, query FROM threshold_cases UNION ALL SELECT 'en-' || id, lower(substr(headword, 1, 5)) FROM entries),
  r1 AS (SELECT id, trim(coalesce(query, ''), ' ') AS query, length(coalesce(query, '')) AS n FROM r0),
  r2 AS (SELECT id AS request_id, query, {_PICK(4, None, 'hybrid', 'lexical', 'hybrid')} AS mode, coalesce({_PICK(3, None, 'true', 'false')}, 'false') AS submitted,
    CASE WHEN id NOT LIKE 'en-%' THEN {_PICK(6, None, 'sense,example', 'sense', '', 'phrase,,form', 'unknown')} END AS scope, {_PICK(5, None, '7', '0', '50', 'x')} AS l, {_PICK(7, None, '3', '511', '512', '-1', '0', '9')} AS o,
    regexp_matches(query, '[{CJK}]') AS cjk FROM r1),
  r3 AS (SELECT *, CASE WHEN query = '' THEN 'invalid_query' WHEN length(query) > 200 THEN 'query_too_long' WHEN cjk AND scope = '' THEN NULL WHEN cjk AND scope IN ('phrase,,form', 'unknown') THEN 'invalid_scope'
    WHEN cjk AND l IN ('0', 'x') THEN 'invalid_limit' WHEN cjk AND o IN ('512', '-1') THEN 'invalid_offset' WHEN NOT cjk AND scope IS NOT NULL THEN 'invalid_scope' WHEN NOT cjk AND l IN ('0', 'x') THEN 'invalid_limit' END AS error,
    cjk AND coalesce(scope = '', false) AS none FROM r2),
  routes AS (SELECT request_id, query, CASE WHEN error IS NOT NULL THEN NULL WHEN none THEN 'none' WHEN cjk AND mode = 'hybrid' AND len(regexp_extract_all(query, '[{CJK}]')) >= 2 THEN 'hybrid' WHEN cjk THEN 'reverse'
    WHEN submitted = 'true' THEN 'plan' ELSE 'suggest' END AS route, error, CASE WHEN error IS NULL AND NOT none THEN coalesce(l::INT, CASE WHEN cjk THEN 32 ELSE 20 END) END AS "limit",
    CASE WHEN error IS NULL AND NOT none AND cjk THEN coalesce(o::INT, 0) END AS "offset", CASE WHEN error IS NULL AND NOT none AND cjk THEN coalesce(scope, 'sense,phrase,form,example,resource') END AS scopes FROM r3)"""
_ARTICLE_TERMS = "terms AS (SELECT DISTINCT term_normalized AS term FROM etymology_articles WHERE term_normalized IS NOT NULL)"

QUERIES = {f.__name__: f for f in (request_routes, request_suggestions, entry_fetch, article_typos, headword_forms, headword_terms, table_fingerprint)}
ORACLE = {
    "request_routes": f"WITH {_ROUTES.replace('coalesce(l::INT', 'coalesce(try_cast(l AS INT)').replace('coalesce(o::INT', 'coalesce(try_cast(o AS INT)')} SELECT * FROM routes",
    "entry_fetch": """WITH i AS (SELECT DISTINCT entry_id AS id FROM search_documents WHERE entry_id IS NOT NULL UNION SELECT entry_id || 'x' FROM etymology_articles WHERE entry_id IS NOT NULL),
        a AS (SELECT * FROM etymology_articles WHERE term_normalized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at DESC, position_no) = 1),
        s AS (SELECT term_normalized AS term, count(*)::INT AS n, first(id ORDER BY position_no, id) AS f FROM a GROUP BY 1)
        SELECT i.id, CASE WHEN e.id IS NULL THEN 'entry_not_found' ELSE 'ok' END AS status, headword, least(coalesce(n, 0), 64) AS articles, f AS first_article
        FROM i LEFT JOIN entries e USING (id) LEFT JOIN s ON s.term = translate(lower(regexp_replace(trim(headword), '[·‧]', '', 'g')), '‘’‛＇', '''''''''')""",
    "article_typos": f"""WITH {_ARTICLE_TERMS}, {DELETES}, wanted AS (SELECT DISTINCT {_SWAPPED} AS query_id, lower(regexp_replace(trim({_SWAPPED}), '[·‧]', '', 'g')) AS q FROM entries WHERE headword IS NOT NULL),
        w AS (SELECT * FROM wanted WHERE regexp_full_match(q, '[a-z]{{3,64}}')),
        swaps AS (SELECT query_id, i, substr(q, 1, i - 1) || substr(q, i + 1, 1) || substr(q, i, 1) || substr(q, i + 2) AS term FROM w, LATERAL (SELECT unnest(range(1, length(q))) AS i) WHERE substr(q, i, 1) <> substr(q, i + 1, 1)),
        drops AS (SELECT query_id, 1000 + i AS i, substr(q, 1, i - 1) || substr(q, i + 1) AS term FROM w, LATERAL (SELECT unnest(range(1, length(q) + 1)) AS i)),
        directs AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS rank FROM (FROM swaps UNION ALL FROM drops) GROUP BY query_id, term),
        shifts AS (SELECT query_id, count(*) AS shift FROM directs GROUP BY 1),
        probes AS (SELECT query_id, signature, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS spot FROM (SELECT query_id, q AS signature, 0 AS i FROM w UNION ALL SELECT query_id, term, i FROM drops) GROUP BY 1, 2),
        best AS (SELECT query_id, term, min(rank) AS rank FROM (SELECT query_id, term, rank FROM directs JOIN terms USING (term) UNION ALL SELECT query_id, term, shift + spot FROM probes JOIN shifts USING (query_id) JOIN deletes USING (signature)) GROUP BY 1, 2),
        kept AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, term) <= 128)
        SELECT query_id, term, rank::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, {FOLD % 'term'}, term)::INT AS place FROM kept QUALIFY place <= 20""",
    "headword_forms": """WITH f AS (SELECT DISTINCT entry_id, headword AS form FROM search_documents WHERE entry_id IS NOT NULL AND trim(headword, ' ') <> '')
        SELECT entry_id, count(*)::INT AS n, string_agg(form, '|' ORDER BY form) AS forms FROM f WHERE entry_id IN (SELECT entry_id FROM etymology_articles) GROUP BY 1""",
    "headword_terms": r"""WITH f AS (SELECT DISTINCT entry_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(headword, '[ˈˌ]', '', 'g'), '[‐‑‒–—−]', '-', 'g')), '\p{Han}', ' ', 'g'), '[^\x00-\x7F\pL\pN]', ' ', 'g') AS h
          FROM search_documents WHERE entry_id IS NOT NULL),
        t AS (SELECT entry_id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(h, '([^\x00-\x7F][-'']{0,8})[a-z0-9]+(?:[-''][a-z0-9]+)*', '\1', 'g'), '[a-z0-9]+(?:[-''][a-z0-9]+)*([-'']{0,8}[^\x00-\x7F])', '\1', 'g'),
          '[a-z0-9]+(?:[-''][a-z0-9]+)*'), ' ') AS term FROM f)
        SELECT DISTINCT term, entry_id FROM t WHERE term <> ''""",
}
