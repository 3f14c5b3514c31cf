"""Term indexes and suggestions over the entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.functions import typo
from glossa.operators import index, lexical
from glossa.session import table

KEY = "lower(regexp_replace(trim(headword), '[·‧]', '', 'g'))"
TERMS = f"terms AS (SELECT DISTINCT {KEY} AS term, id AS entry_id FROM entries WHERE {KEY} <> '')"
DELETES = """deletes AS (SELECT DISTINCT substr(term, 1, i - 1) || substr(term, i + 1) AS signature, term
  FROM (SELECT DISTINCT term FROM terms WHERE regexp_full_match(term, '[a-z]{3,64}')), LATERAL (SELECT unnest(range(1, length(term) + 1)) AS i))"""
FOLD = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entries").select("id", "headword")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return index.entry_terms(_entries(spark, sf), "id", "headword")


def _prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Every beginning of four characters of any headword, as a query."""
    first = _entries(spark, sf).select(F.lower(F.substring("headword", 1, 4)).alias("query")).distinct()
    return first.filter("query <> ''").select(F.col("query").alias("query_id"), "query")


def _misspelt(spark: SparkSession, sf: str) -> DataFrame:
    """Every headword with its second and third letters exchanged, as a query."""
    h = F.col("headword")
    swapped = F.concat(F.substring(h, 1, 1), F.substring(h, 3, 1), F.substring(h, 2, 1), F.substring(h, F.lit(4), F.length(h)))
    return _entries(spark, sf).select(swapped.alias("query")).distinct().select(F.col("query").alias("query_id"), "query")


def entry_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf)


def delete_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return index.term_deletes(_terms(spark, sf))


def prefix_suggest(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.prefix_matches(_prefixes(spark, sf), _terms(spark, sf), _entries(spark, sf))


def typo_suggest(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark, sf)
    return lexical.typo_matches(_misspelt(spark, sf), terms, index.term_deletes(terms), _entries(spark, sf))


def suggest_batch(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark, sf)
    queries = _prefixes(spark, sf).unionByName(_misspelt(spark, sf)).distinct()
    return lexical.suggestions(queries, terms, index.term_deletes(terms), _entries(spark, sf))


def direct_candidates(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark, sf).select("term").distinct().filter(typo.eligible(F.col("term")))
    return terms.select("term", F.posexplode(typo.direct_candidates(F.col("term"))).alias("place", "candidate"))


def term_variants(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("id", F.explode(X.query_variants(F.concat("headword", F.lit("’s·way")))).alias("variant"))


def etymology_in_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of articles with and without a dictionary entry."""
    etymology = table(spark, sf, "etymology_articles").select(F.col("term_normalized").alias("term")).filter("term is not null").distinct()
    known = _terms(spark, sf).select("term").distinct().withColumn("known", F.lit(True))
    return etymology.join(known, "term", "left").select("term", F.coalesce("known", F.lit(False)).alias("known"))


def merge_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary terms, and article terms that are not among them."""
    main = _terms(spark, sf).select("term", F.lit("dictionary").alias("kind")).distinct()
    extra = table(spark, sf, "etymology_articles").select(F.col("term_normalized").alias("term"), F.lit("etymology").alias("kind")).filter("term is not null").distinct()
    return lexical.merged(main, extra, "term")


def entry_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of ten entries of each dictionary."""
    rows = table(spark, sf, "entries").select("dictionary_id", "id", "headword").filter("dictionary_id is not null")
    return lexical.page(rows, "dictionary_id", [X.ascii_lower(F.col("headword")), "id"], 10, 10)


def regular_stems(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "search_documents").select(F.explode(X.planner_tokens(F.col("english_text"))).alias("word")).distinct()
    return words.select("word", F.explode(X.stems(F.col("word"))).alias("stem"))


_PREFIX = f"""{TERMS},
  queries AS (SELECT DISTINCT lower(substr(headword, 1, 4)) AS query_id FROM entries WHERE headword <> ''),
  spelled AS (SELECT query_id, unnest(list_distinct([p, a, translate(a, '''', '’')])) AS prefix
    FROM (SELECT query_id, p, translate(p, '‘’‛＇', '''''''''') AS a FROM (SELECT query_id, lower(regexp_replace(trim(query_id), '[·‧]', '', 'g')) AS p FROM queries))),
  matched AS (SELECT query_id, prefix, entry_id, min(CASE WHEN term = prefix THEN 0 ELSE 1 END) AS rank,
      min(CASE WHEN contains(term, ' ') THEN 1 ELSE 0 END) AS phrase, min(length(term)) AS size, min(term) AS sort_term
    FROM spelled JOIN terms ON starts_with(term, prefix) WHERE prefix <> '' GROUP BY ALL),
  paged AS (SELECT *, row_number() OVER (PARTITION BY query_id, prefix ORDER BY rank, phrase, size, {FOLD % 'sort_term'}, entry_id) AS n FROM matched),
  merged AS (SELECT query_id, entry_id, headword, min(rank) AS rank FROM paged JOIN entries ON id = entry_id WHERE n <= 20 GROUP BY ALL),
  prefix_found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY rank, CASE WHEN contains(headword, ' ') THEN 1 ELSE 0 END, length(headword), {FOLD % 'headword'}, entry_id) AS place FROM merged) WHERE place <= 20)"""
_SWAPPED = "substr(headword, 1, 1) || substr(headword, 3, 1) || substr(headword, 2, 1) || substr(headword, 4)"


def _typos(source: str) -> str:
    """Common table expressions from typo_queries(query_id) to typo_found."""
    return f"""wanted AS (SELECT query_id, q FROM (SELECT query_id, lower(regexp_replace(trim(query_id), '[·‧]', '', 'g')) AS q FROM {source}) WHERE regexp_full_match(q, '[a-z]{{3,64}}')),
  swaps AS (SELECT query_id, i, substr(q, 1, i - 1) || substr(q, i + 1, 1) || substr(q, i, 1) || substr(q, i + 2) AS term
    FROM wanted, LATERAL (SELECT unnest(range(1, length(q))) AS i) WHERE substr(q, i, 1) <> substr(q, i + 1, 1)),
  drops AS (SELECT query_id, 1000 + i AS i, substr(q, 1, i - 1) || substr(q, i + 1) AS term FROM wanted, LATERAL (SELECT unnest(range(1, length(q) + 1)) AS i)),
  directs AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS rank FROM (FROM swaps UNION ALL FROM drops) GROUP BY query_id, term),
  shifts AS (SELECT query_id, count(*) AS shift FROM directs GROUP BY 1),
  probes AS (SELECT query_id, signature, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS spot
    FROM (SELECT query_id, q AS signature, 0 AS i FROM wanted UNION ALL SELECT query_id, term, i FROM drops) GROUP BY 1, 2),
  best AS (SELECT query_id, entry_id, min(rank) AS rank FROM (
      SELECT query_id, entry_id, rank FROM directs JOIN terms USING (term)
      UNION ALL SELECT query_id, entry_id, shift + spot FROM probes JOIN shifts USING (query_id) JOIN deletes USING (signature) JOIN terms USING (term)) GROUP BY 1, 2),
  typo_found AS (SELECT * FROM (SELECT query_id, entry_id, headword, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, {FOLD % 'headword'}, entry_id) AS place
    FROM best JOIN entries ON id = entry_id) WHERE place <= 20)"""


QUERIES = {
    "entry_terms": entry_terms,
    "delete_signatures": delete_signatures,
    "prefix_suggest": prefix_suggest,
    "typo_suggest": typo_suggest,
    "suggest_batch": suggest_batch,
    "direct_candidates": direct_candidates,
    "term_variants": term_variants,
    "etymology_in_dictionary": etymology_in_dictionary,
    "merge_suggestions": merge_suggestions,
    "entry_page": entry_page,
    "regular_stems": regular_stems,
}
ORACLE = {
    "entry_terms": f"WITH {TERMS} SELECT term, entry_id FROM terms",
    "delete_signatures": f"WITH {TERMS}, {DELETES} SELECT signature, term FROM deletes",
    "prefix_suggest": f"WITH {_PREFIX} SELECT query_id, entry_id, headword, rank, place::INT AS place FROM prefix_found",
    "typo_suggest": f"WITH {TERMS}, {DELETES}, misspelt AS (SELECT DISTINCT {_SWAPPED} AS query_id FROM entries WHERE headword IS NOT NULL), {_typos('misspelt')} SELECT query_id, entry_id, headword, rank::INT AS rank, place::INT AS place FROM typo_found",
    "suggest_batch": f"""WITH {_PREFIX.replace("SELECT DISTINCT lower(substr(headword, 1, 4)) AS query_id FROM entries WHERE headword <> ''", f"SELECT lower(substr(headword, 1, 4)) AS query_id FROM entries WHERE headword <> '' UNION SELECT {_SWAPPED} FROM entries WHERE headword IS NOT NULL")},
        {DELETES}, without AS (SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM prefix_found)), {_typos('without')}
        SELECT query_id, entry_id, headword, rank, place::INT AS place, 'prefix' AS kind FROM prefix_found UNION ALL SELECT query_id, entry_id, headword, (rank + 2)::INT, place::INT, 'typo' FROM typo_found""",
    "direct_candidates": f"""WITH {TERMS}, wanted AS (SELECT DISTINCT term AS q FROM terms WHERE regexp_full_match(term, '[a-z]{{3,64}}')),
        made AS (SELECT q, i, substr(q, 1, i - 1) || substr(q, i + 1, 1) || substr(q, i, 1) || substr(q, i + 2) AS c FROM wanted, LATERAL (SELECT unnest(range(1, length(q))) AS i) WHERE substr(q, i, 1) <> substr(q, i + 1, 1)
          UNION ALL SELECT q, 1000 + i, substr(q, 1, i - 1) || substr(q, i + 1) FROM wanted, LATERAL (SELECT unnest(range(1, length(q) + 1)) AS i))
        SELECT q AS term, (row_number() OVER (PARTITION BY q ORDER BY min(i)) - 1)::INT AS place, c AS candidate FROM made GROUP BY q, c""",
    "term_variants": """SELECT id, unnest(list_distinct([p, a, translate(a, '''', '’')])) AS variant
        FROM (SELECT id, p, translate(p, '‘’‛＇', '''''''''') AS a FROM (SELECT id, lower(regexp_replace(trim(headword || '’s·way'), '[·‧]', '', 'g')) AS p FROM entries))""",
    "etymology_in_dictionary": f"WITH {TERMS} SELECT term, term IN (SELECT term FROM terms) AS known FROM (SELECT DISTINCT term_normalized AS term FROM etymology_articles WHERE term_normalized IS NOT NULL)",
    "merge_suggestions": f"""WITH {TERMS} SELECT DISTINCT term, 'dictionary' AS kind FROM terms
        UNION ALL SELECT DISTINCT term_normalized, 'etymology' FROM etymology_articles WHERE term_normalized IS NOT NULL AND term_normalized NOT IN (SELECT term FROM terms)""",
    "regular_stems": r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(translate(lower(trim(english_text)), '’', ''''), '[\pL\p{Nd}]+(?:[''-][\pL\p{Nd}]+)*')) AS word FROM search_documents WHERE english_text IS NOT NULL),
        k AS (SELECT word, CASE WHEN length(word) > 4 AND regexp_matches(word, 'ie[ds]$') THEN 'y' WHEN length(word) > 4 AND suffix(word, 'ed') THEN 'ed' WHEN length(word) > 5 AND suffix(word, 'ing') THEN 'ing'
          WHEN length(word) > 4 AND suffix(word, 'es') THEN 'es' WHEN length(word) > 3 AND suffix(word, 's') THEN 's' END AS kind FROM w WHERE regexp_full_match(word, '[a-z]+')),
        c AS (SELECT word, kind, CASE WHEN kind = 'y' THEN word[:-4] || 'y' ELSE word[:-(length(kind) + 1)] END AS stem FROM k WHERE kind IS NOT NULL),
        d AS (SELECT word, stem, kind, kind IN ('ed', 'ing') AND stem[-1] = stem[-2] AND NOT contains('aeiou', stem[-1]) AS doubled FROM c),
        s AS (SELECT word, CASE WHEN doubled THEN stem[:-2] ELSE stem END AS stem FROM d UNION SELECT word, stem || 'e' FROM d WHERE kind IN ('ed', 'ing') AND NOT doubled)
        SELECT word, stem FROM s WHERE length(stem) >= 3 AND stem <> word""",
    "entry_page": f"""SELECT dictionary_id, id, headword, place::INT AS place, n > 20 AS has_more, CASE WHEN n > 20 THEN 20 END AS next_offset FROM (
        SELECT dictionary_id, id, headword, row_number() OVER (PARTITION BY dictionary_id ORDER BY {FOLD % 'headword'}, id) AS place, count(*) OVER (PARTITION BY dictionary_id) AS n
        FROM entries WHERE dictionary_id IS NOT NULL) WHERE place BETWEEN 11 AND 20""",
}
