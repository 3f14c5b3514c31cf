"""Canonical pieces of entries: term matches, deduplication by place, parts, labels, resolutions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import canonical, islands, lexical
from glossa.plans.lexical_queries import _PREFIX, _entries, _prefixes, _terms
from glossa.plans.request_queries import _ROUTES, request_routes
from glossa.session import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "search_documents").drop("imported_at").distinct().filter("id is not null")


def term_index(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.term_index(_docs(spark, sf)).select("term", "entry_id", "kind", "display", "id")


def term_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of every term of an article."""
    asked = table(spark, sf, "etymology_articles").select(F.col("term_normalized").alias("term")).filter("term is not null").distinct()
    return canonical.term_matches(asked.withColumn("query_id", F.col("term")), canonical.term_index(_docs(spark, sf))).select("query_id", "entry_id", "kind", "display", "id", "place")


def _depth() -> F.Column:
    path = F.from_json("path_json", "array<string>")
    return F.size(path) * 2 + F.exists(path, lambda p: (p == "segments") | F.endswith(p, F.lit("Segments"))).cast("int")


def deepest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One document of each entry's equal texts in a section, the deepest."""
    d = _docs(spark, sf).filter("entry_id is not null and chinese_text is not null")
    signature = [F.col("entry_id"), F.col("scope"), F.col("section"), *(F.coalesce(c, F.lit("")) for c in ("part", "english_text", "candidate_text", "definition_text")), F.col("chinese_text")]
    return canonical.deepest(d, signature, _depth(), "id").select("id", "entry_id", "position")


def specific_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Resources of each entry, of one category the deepest; those without a category all stay."""
    d = _docs(spark, sf).filter("entry_id is not null")
    return canonical.most_specific(d, ["entry_id"], "resource_category", F.size(F.from_json("path_json", "array<string>")), "id").select("id", "entry_id", "resource_category", "position")


def last_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The three entries that each backup visited last."""
    return canonical.last_used(table(spark, sf, "history").filter("backup_id is not null and entry_id is not null"), "backup_id", "entry_id", "visited_at").select("backup_id", "entry_id", "place")


def parts_of_speech(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct parts of speech of every entry, and its part where there is only one."""
    e = table(spark, sf, "entries").select("id", F.col("parts_of_speech").alias("p"))
    spelled = F.transform(F.concat("p", F.transform("p", lambda x: F.upper(x))), lambda x: x)
    return e.select("id", F.array_join(canonical.distinct_parts(spelled), "|").alias("parts"), canonical.unambiguous_part(F.col("p")).alias("part"))


def group_ends(spark: SparkSession, sf: str) -> DataFrame:
    """First and last document of each entry's part."""
    d = _docs(spark, sf).filter("entry_id is not null").select("id", "entry_id", "part").distinct()
    ends = canonical.group_ends(d, ["entry_id", "part"], "id").filter("first or last")
    return ends.select("id", "entry_id", "part", "first", "last")


def result_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """How many suggestions of each prefix are left when exact ones are followed."""
    found = lexical.prefix_matches(_prefixes(spark, sf), _terms(spark, sf), _entries(spark, sf))
    items = found.select("query_id", F.lit("dictionary").alias("kind"), F.col("entry_id").alias("key"), "headword")
    return canonical.resolved(items, F.col("query_id"), F.lit(False)).groupBy("query_id", "resolution").agg(F.count("*").alias("items"), F.min("key").alias("first_key"))


def semantic_status(spark: SparkSession, sf: str) -> DataFrame:
    """What semantic search adds to each request, where the queries that are texts themselves have an answer."""
    routes = request_routes(spark, sf).filter("route is not null")
    known = routes.join(table(spark, sf, "texts").select(F.col("normalized_chinese_text").alias("query")).distinct(), "query", "left_semi").select("request_id")
    return canonical.semantic_status(routes, known).groupBy("route", "status").agg(F.count("*").alias("requests"))


def violation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred violations of the search documents, with the count of each rule."""
    rules = {"no english text": F.col("english_text").isNull(), "negative weight": F.col("weight") < 0, "no owner": F.col("owner_id").isNull(), "resource without category": (F.col("scope") == "resource") & (F.coalesce("resource_category", F.lit("")) == "")}
    broken = islands.violations(_docs(spark, sf).select("id", "english_text", "weight", "owner_id", "scope", "resource_category").distinct(), "id", rules)
    return canonical.report(broken, "rule", "id")


def usage_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Usage notes that an entry has more or less often as resources than as definitions or examples."""
    d = _docs(spark, sf).filter("entry_id is not null and chinese_text is not null").select("entry_id", "chinese_text", "scope")
    return islands.multiset_difference(d.filter("scope in ('sense', 'example')"), d.filter("scope = 'resource'"), ["entry_id", "chinese_text"])


def resource_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Category of each kind of resource, written as a source would."""
    kind = F.upper(F.concat(F.regexp_replace("resource_category", "-", " "), F.when(F.length("resource_category") % 2 == 0, F.lit("  note")).otherwise("")))
    d = table(spark, sf, "search_documents").select("resource_category", "origin").distinct()
    categories = [("WHICH WORD", "which-word"), ("WORD", "word"), ("GRAMMAR", "grammar"), ("EXPRESS YOURSELF", "express-yourself"), ("VOCABULARY BUILDING", "vocabulary-building"), ("ORIGIN", "origin")]
    return d.select("resource_category", "origin", X.prefixed_category(kind, categories).alias("category"))


def label_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of each entry's documents by labels written from its payload size."""
    n = F.col("payload_size")
    level = F.element_at(F.array(*(F.lit(x) for x in ("A1", "A2", "B1", "B2", "C1", "C2"))), (n % 6 + 1).cast("int"))
    text = F.concat(F.lit("[CEFR_"), level, F.lit("] x [OPAL_W] [Ox"), F.when(n % 2 == 0, "3000").otherwise("5000"), F.lit("] [other]"))
    e = table(spark, sf, "entries").select("id", X.metadata_labels(text).alias("labels"))
    return e.select("id", F.array_join(F.transform("labels", lambda x: F.concat_ws("=", x["kind"], x["text"])), " ").alias("labels"), canonical.document_weight(F.lit("sense"), F.col("labels")).alias("weight"))


_TERM = r"""array_to_string(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(%s, '[ˈˌ]', '', 'g'), '[‐‑‒–—−]', '-', 'g')), '\p{Han}', ' ', 'g'),
  '[^\x00-\x7F\pL\pN]', ' ', 'g'), '([^\x00-\x7F][-'']{0,8})[a-z0-9]+(?:[-''][a-z0-9]+)*', '\1', 'g'), '[a-z0-9]+(?:[-''][a-z0-9]+)*([-'']{0,8}[^\x00-\x7F])', '\1', 'g'), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), ' ')"""
_DOCS = "d AS (SELECT DISTINCT * EXCLUDE (imported_at) FROM search_documents WHERE id IS NOT NULL)"
_INDEX = f"""{_DOCS}, own AS (SELECT entry_id, first(headword ORDER BY id, headword) AS own FROM d WHERE entry_id IS NOT NULL AND headword IS NOT NULL GROUP BY 1),
  sp AS (SELECT DISTINCT entry_id, headword, own, {_TERM % 'headword'} AS term FROM d JOIN own USING (entry_id) WHERE headword IS NOT NULL),
  hd AS (SELECT term, entry_id, CASE WHEN headword = own THEN 'headword' ELSE 'form' END AS kind, headword AS display, own, NULL::BIGINT AS id FROM sp QUALIFY row_number() OVER (PARTITION BY term, entry_id ORDER BY headword <> own, headword) = 1),
  ph AS (SELECT DISTINCT {_TERM % 'candidate_text'} AS term, entry_id, 'phrase' AS kind, candidate_text AS display, headword AS own, id FROM d WHERE scope = 'phrase' AND entry_id IS NOT NULL),
  ix AS (SELECT * FROM (FROM hd UNION ALL FROM ph) WHERE term <> '')"""

QUERIES = {f.__name__: f for f in (
    term_index, term_matches, deepest_documents, specific_resources, last_pages, parts_of_speech, group_ends, result_resolution, semantic_status, violation_report, usage_difference, resource_categories, label_weights,
)}
ORACLE = {
    "term_index": f"WITH {_INDEX} SELECT term, entry_id, kind, display, id FROM ix",
    "term_matches": f"""WITH {_INDEX}, q AS (SELECT DISTINCT term_normalized AS term FROM etymology_articles WHERE term_normalized IS NOT NULL)
        SELECT term AS query_id, entry_id, kind, display, id, row_number() OVER (PARTITION BY term ORDER BY CASE kind WHEN 'headword' THEN 0 WHEN 'form' THEN 1 ELSE 2 END, length(display) NULLS FIRST,
          translate(CASE WHEN kind = 'headword' THEN display ELSE own END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NULLS FIRST, entry_id, id NULLS FIRST)::INT AS place FROM q JOIN ix USING (term) QUALIFY place <= 16""",
    "deepest_documents": f"""WITH {_DOCS}, k AS (SELECT id, entry_id, scope, section, coalesce(part, '') AS p, coalesce(english_text, '') AS e, coalesce(candidate_text, '') AS c, coalesce(definition_text, '') AS f, chinese_text AS z,
          json_array_length(path_json) * 2 + len(list_filter(json_extract_string(path_json, '$[*]'), lambda x: x = 'segments' OR suffix(x, 'Segments'))).least(1) AS depth FROM d WHERE entry_id IS NOT NULL AND chinese_text IS NOT NULL)
        SELECT id, entry_id, position FROM (SELECT *, min(id) OVER w AS position, row_number() OVER (PARTITION BY entry_id, scope, section, p, e, c, f, z ORDER BY depth DESC, id) AS n FROM k WINDOW w AS (PARTITION BY entry_id, scope, section, p, e, c, f, z)) WHERE n = 1""",
    "specific_resources": f"""WITH {_DOCS}, k AS (SELECT *, coalesce(trim(resource_category, ' '), '') = '' AS lone, json_array_length(path_json) AS s FROM d WHERE entry_id IS NOT NULL)
        SELECT id, entry_id, resource_category, id AS position FROM k WHERE lone UNION ALL
        SELECT id, entry_id, resource_category, position FROM (SELECT *, min(id) OVER (PARTITION BY entry_id, resource_category) AS position, row_number() OVER (PARTITION BY entry_id, resource_category ORDER BY s DESC, id) AS n FROM k WHERE NOT lone) WHERE n = 1""",
    "last_pages": "SELECT backup_id, entry_id, row_number() OVER (PARTITION BY backup_id ORDER BY u DESC, entry_id)::INT AS place FROM (SELECT backup_id, entry_id, max(visited_at) AS u FROM history WHERE backup_id IS NOT NULL AND entry_id IS NOT NULL GROUP BY 1, 2) QUALIFY place <= 3",
    "parts_of_speech": r"""WITH k AS (SELECT id, parts_of_speech IS NULL AS none, generate_subscripts(parts_of_speech, 1) AS i, unnest(parts_of_speech) AS p FROM entries),
        n AS (SELECT id, p, i, lower(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS k FROM k), f AS (SELECT id, first(p ORDER BY i) AS p, min(i) AS i, k FROM n WHERE k <> '' GROUP BY id, k),
        g AS (SELECT id, string_agg(p, '|' ORDER BY i) AS parts, CASE WHEN count(*) = 1 THEN min(k) END AS part FROM f GROUP BY 1)
        SELECT e.id, CASE WHEN parts_of_speech IS NULL THEN NULL ELSE coalesce(parts, '') END AS parts, part FROM entries e LEFT JOIN g USING (id)""",
    "group_ends": f"""WITH {_DOCS}, k AS (SELECT DISTINCT id, entry_id, part FROM d WHERE entry_id IS NOT NULL), e AS (SELECT *, id = min(id) OVER (PARTITION BY entry_id, part) AS first, id = max(id) OVER (PARTITION BY entry_id, part) AS last FROM k)
        SELECT id, entry_id, part, first, last FROM e WHERE first OR last""",
    "result_resolution": f"""WITH {_PREFIX}, x AS (SELECT query_id, entry_id, lower(trim(headword)) = lower(trim(query_id)) AS exact, sum((lower(trim(headword)) = lower(trim(query_id)))::INT) OVER (PARTITION BY query_id) AS n FROM prefix_found)
        SELECT query_id, CASE WHEN n = 1 THEN 'direct' ELSE 'candidates' END AS resolution, count(*) AS items, min(entry_id) AS first_key FROM x WHERE n <> 1 OR exact GROUP BY 1, 2""",
    "semantic_status": f"""WITH {_ROUTES.replace('coalesce(l::INT', 'coalesce(try_cast(l AS INT)').replace('coalesce(o::INT', 'coalesce(try_cast(o AS INT)')}
        SELECT route, CASE WHEN route <> 'hybrid' THEN 'not_eligible' WHEN query IN (SELECT normalized_chinese_text FROM texts) THEN 'applied' ELSE 'degraded' END AS status, count(*) AS requests FROM routes WHERE route IS NOT NULL GROUP BY 1, 2""",
    "violation_report": f"""WITH {_DOCS}, u AS (SELECT DISTINCT id, english_text, weight, owner_id, scope, resource_category FROM d), v AS (SELECT id, unnest(list_filter([CASE WHEN english_text IS NULL THEN 'no english text' END, CASE WHEN weight < 0 THEN 'negative weight' END,
          CASE WHEN owner_id IS NULL THEN 'no owner' END, CASE WHEN scope = 'resource' AND coalesce(resource_category, '') = '' THEN 'resource without category' END], lambda x: x IS NOT NULL)) AS rule FROM u),
        n AS (SELECT rule, count(*) AS violations FROM v GROUP BY 1), f AS (SELECT DISTINCT rule, id FROM v ORDER BY rule, id LIMIT 100)
        SELECT rule, id, row_number() OVER (ORDER BY rule, id)::INT AS place, violations FROM f JOIN n USING (rule)""",
    "usage_difference": f"""WITH {_DOCS}, k AS (SELECT entry_id, chinese_text, sum(CASE WHEN scope = 'resource' THEN -1 ELSE 1 END) AS n FROM d WHERE entry_id IS NOT NULL AND chinese_text IS NOT NULL AND scope IN ('sense', 'example', 'resource') GROUP BY 1, 2)
        SELECT entry_id, chinese_text, greatest(n, 0)::BIGINT AS missing, greatest(-n, 0)::BIGINT AS unexpected FROM k WHERE n <> 0""",
    "resource_categories": """WITH k AS (SELECT DISTINCT resource_category, origin FROM search_documents), n AS (SELECT *, upper(replace(resource_category, '-', ' ')) || CASE WHEN length(resource_category) % 2 = 0 THEN ' NOTE' ELSE '' END || ' ' AS s FROM k)
        SELECT resource_category, origin, CASE WHEN starts_with(s, 'WHICH WORD ') THEN 'which-word' WHEN starts_with(s, 'WORD ') THEN 'word' WHEN starts_with(s, 'GRAMMAR ') THEN 'grammar' WHEN starts_with(s, 'EXPRESS YOURSELF ') THEN 'express-yourself'
          WHEN starts_with(s, 'VOCABULARY BUILDING ') THEN 'vocabulary-building' WHEN starts_with(s, 'ORIGIN ') THEN 'origin' ELSE 'other' END AS category FROM n""",
    "label_weights": """SELECT id, 'level=' || l || ' academic-register=W frequency=' || CASE WHEN payload_size % 2 = 0 THEN '3000' ELSE '5000' END AS labels,
          (160 + ([160, 120, 85, 50, 25, 10])[payload_size % 6 + 1] + CASE WHEN payload_size % 2 = 0 THEN 40 ELSE 20 END)::INT AS weight FROM (SELECT *, (['A1', 'A2', 'B1', 'B2', 'C1', 'C2'])[payload_size % 6 + 1] AS l FROM entries)""",
}
