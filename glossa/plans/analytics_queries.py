"""Evaluation sets, state from event logs, and corpus audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import evaluate, islands, state
from glossa.operators.index import first_per
from glossa.session import table

TABLES = ("entries", "search_documents", "texts", "vector_blocks", "threshold_cases", "etymology_articles", "history", "documents", "holdout_passages", "subjects", "subject_labels")


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "threshold_cases").drop("added_at").distinct()


def pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of answerable cases by category with its lower bound."""
    by = _cases(spark, sf).groupBy("category").agg(F.count("*").alias("cases"), F.sum((F.col("label") == "answerable").cast("long")).alias("answerable"))
    return by.select("category", "cases", "answerable", F.round(evaluate.wilson_lower(F.col("answerable"), F.col("cases")), 6).alias("lower"))


def category_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Cases by split and category, by split, and in all."""
    return _cases(spark, sf).rollup("split", "category").agg(F.grouping_id().alias("level"), F.count("*").alias("cases"), F.countDistinct("source").alias("sources"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).filter("query is not null").select(F.round(F.length("query") / 100, 2).alias("score"), (F.col("label") == "answerable").alias("answerable"))


def threshold_table(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.thresholds(_scores(spark, sf)).select("threshold", "above", F.round("retention", 6).alias("retention"), F.round("rejection", 6).alias("rejection"))


def threshold_choice(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.calibrated(threshold_table(spark, sf), 0.95)


def threshold_pareto(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.pareto(threshold_table(spark, sf))


def shared_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Query signatures that occur in more than one split."""
    s = _cases(spark, sf).filter("query is not null and split is not null").select(X.query_signature(F.col("query")).alias("signature"), "split").distinct()
    return s.groupBy("signature").agg(F.count("*").alias("splits")).filter("splits > 1")


def case_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Cases by the rule they break."""
    rules = {
        "no query": F.coalesce(F.trim("query"), F.lit("")) == "",
        "no split": F.col("split").isNull(),
        "unknown label": ~F.coalesce(F.col("label"), F.lit("")).isin("answerable", "reject"),
        "answerable without target": (F.col("label") == "answerable") & (F.size("targets") < 1),
        "reject with target": (F.col("label") == "reject") & (F.size("targets") > 0),
    }
    return islands.violations(_cases(spark, sf), "id", rules).groupBy("rule").agg(F.countDistinct("id").alias("cases"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("event_type")
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return e.agg(F.count("*").alias("requests"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """95th percentile by nearest rank, from positions instead of collected values."""
    e = table(spark, sf, "events").filter("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    w = islands.Window.partitionBy("event_type")
    run = e.withColumns({"upto": F.sum("n").over(w.orderBy("value")), "total": F.sum("n").over(w)})
    return run.filter("upto > floor((total - 1) * 0.95)").groupBy("event_type").agg(F.min("value").alias("p95"))


def visit_counters(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "history").distinct()
    return state.counted(h, ["record_key"], "visited_at", F.coalesce("visit_count", F.lit(0))).select("record_key", "count", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"))


_HISTORY = ("visited_at", "synced_at", "backup_id", "visit_count", "headword")


def _order() -> list:
    return [F.col("visited_at"), F.col("synced_at"), F.col("backup_id"), F.coalesce("visit_count", F.lit(-1)), F.coalesce("headword", F.lit(""))]


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return state.latest(table(spark, sf, "history").select("record_key", *_HISTORY), ["record_key"], _order())


def history_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _latest(spark, sf)
    return rows.select("record_key", F.unix_micros("visited_at").alias("visited_at"), F.unix_micros("synced_at").alias("synced_at"), "backup_id", "visit_count", "headword")


def history_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 newest records of each dictionary."""
    rows = _latest(spark, sf).withColumn("dictionary", F.split("record_key", ":")[0])
    return state.newest(rows, ["dictionary"], [F.desc("visited_at"), "record_key"], 100).select("dictionary", "record_key", F.unix_micros("visited_at").alias("visited_at"), "place")


def history_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose last change names a headword; a change without one deletes the record."""
    rows = table(spark, sf, "history").select("record_key", *_HISTORY)
    return state.without_deleted(rows, ["record_key"], _order(), F.col("headword").isNull()).select("record_key", "headword")


def backup_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the backups with an odd number merged into those with an even one."""
    rows = table(spark, sf, "history").filter("backup_id is not null").select("record_key", *_HISTORY)
    side = lambda n: state.latest(rows.filter(F.col("backup_id") % 2 == n), ["record_key"], _order())
    return state.merged_backup(side(0), side(1), ["record_key"]).select("record_key", "backup_id")


def cache_contents(spark: SparkSession, sf: str) -> DataFrame:
    return state.cache_replay(table(spark, sf, "events"), "event_type", "user_id", "ts", 20 * 86400, 50).select("event_type", "user_id", "created_at", "accessed_at", "place")


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = state.sessions(table(spark, sf, "events"), "user_id", "ts", 6 * 3600, "event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def order_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Running total of each customer's orders: the ledger of reservations."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return evaluate.balance(o, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("cents")).select("o_orderkey", "o_custkey", "balance")


def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The eight dearest orders of each customer, as evidence is gathered by entry."""
    return state.newest(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 8).select("o_custkey", "o_orderkey", "place")


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal events of each user."""
    e = table(spark, sf, "events").withColumn("new", islands.changes("event_type", ["user_id"], ["ts", "event_id"]))
    runs = islands.islands(e, ["user_id"], ["ts", "event_id"], F.col("new"))
    return runs.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("events"))


def event_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase value of each user up to each event."""
    last = islands.filled(F.when(F.col("event_type") == "purchase", F.col("value")), ["user_id"], ["ts", "event_id"])
    return table(spark, sf, "events").select("event_id", last.alias("last_purchase"))


def event_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Nesting depth of each user's events where a view opens and a click closes."""
    e = table(spark, sf, "events")
    return islands.with_depth(e, F.col("event_type") == "view", F.col("event_type") == "click", ["user_id"], ["ts", "event_id"]).select("event_id", F.col("depth").cast("long").alias("depth"))


def structure_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return islands.histogram(table(spark, sf, "search_documents"), "scope", "section", "semantic_role", "resource_category")


def headword_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Headwords of documents that their entry doesn't have, and of entries that no document has, with counts."""
    docs = table(spark, sf, "search_documents").filter("entry_id is not null and headword is not null").select("entry_id", "headword").distinct()
    entries = table(spark, sf, "entries").select(F.col("id").alias("entry_id"), "headword").filter("headword is not null").distinct()
    return islands.multiset_difference(docs, entries, ["entry_id", "headword"])


def hygiene(spark: SparkSession, sf: str) -> DataFrame:
    """Search documents by what is wrong with their headword or text."""
    h = F.col("headword")
    rules = {
        "outer space": h != F.trim(h),
        "double space": F.contains(h, F.lit("  ")),
        "empty": h == "",
        "no text": F.coalesce("english_text", "chinese_text", "definition_text", "candidate_text").isNull(),
        "no owner": F.col("owner_id").isNull(),
        "negative weight": F.col("weight") < 0,
    }
    return islands.violations(table(spark, sf, "search_documents"), "id", rules).groupBy("rule").agg(F.countDistinct("id").alias("documents"))


def payload_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose payload has not the size that is stored with it, and the digest of each."""
    a = table(spark, sf, "etymology_articles").filter("payload is not null").select("id", "payload", "payload_size").distinct()
    return a.select("id", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), (F.octet_length("payload") == F.col("payload_size")).alias("intact"))


def article_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of articles by how many entries own them, and terms without an owner."""
    a = table(spark, sf, "etymology_articles").groupBy("term_normalized").agg(F.countDistinct("entry_id").alias("owners"), F.countDistinct("id").alias("articles"), F.countDistinct("position_no").alias("positions"))
    return a.groupBy("owners").agg(F.count("*").alias("terms"), F.sum("articles").alias("articles"), F.sum((F.col("positions") < F.col("articles")).cast("long")).alias("clashing"))


def article_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The first article of each term with its preview on one line."""
    rows = first_per(table(spark, sf, "etymology_articles").filter("term_normalized is not null"), ["term_normalized"], "position_no", "id", F.desc("imported_at"))
    return rows.select(F.col("term_normalized").alias("term"), "id", X.unwrapped(F.col("label")).alias("label"), X.preview(F.col("preview")).alias("preview"))


def media_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entries").select("id", X.media_url(F.col("headword"), "https://media.example/{prefix1}/{prefix3}/{key}.mp3").alias("url"))


def location_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Path key of each document, and whether it lies within the place of its entry's first document."""
    path = F.from_json("path_json", "array<string>")
    d = table(spark, sf, "search_documents").select("id", "entry_id", "section", path.alias("path"), "owner_id").filter("entry_id is not null").distinct()
    first = d.groupBy("entry_id").agg(F.min_by(F.struct("section", F.slice("path", 1, 2).alias("path"), "owner_id"), "id").alias("f"))
    inside = X.location_contains(F.col("f.section"), F.col("f.path"), F.col("f.owner_id"), F.col("section"), F.col("path"), F.col("owner_id"))
    return d.join(first, "entry_id").select("id", X.path_key(F.col("path")).alias("key"), F.size("path").alias("depth"), inside.alias("inside"))


def english_hits(spark: SparkSession, sf: str) -> DataFrame:
    """How many of its headword's words each document's English text holds."""
    d = table(spark, sf, "search_documents").select("id", "headword", "english_text").filter("headword is not null and english_text is not null").distinct()
    hits = X.evidence_hits(X.filter_tokens(F.col("headword")), F.col("english_text"))
    return d.select("id", "headword", hits.alias("h")).select("id", "headword", F.col("h.significant").alias("significant"), F.col("h.all").alias("every"))


def table_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table."""
    first, *rest = (table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("rows")) for t in TABLES)
    for x in rest:
        first = first.unionByName(x)
    return first


_CASES = "c AS (SELECT DISTINCT * EXCLUDE (added_at) FROM threshold_cases)"
_THRESHOLDS = f"""{_CASES}, s AS (SELECT round(length(query) / 100, 2) AS score, label = 'answerable' AS answerable FROM c WHERE query IS NOT NULL),
  tot AS (SELECT sum(answerable::INT) AS ta, sum((NOT answerable)::INT) AS tr FROM s), t AS (SELECT score, above FROM (SELECT DISTINCT score FROM s), (VALUES (false), (true)) b(above)),
  th AS (SELECT t.score AS threshold, above, round(sum(CASE WHEN answerable AND (s.score > t.score OR (NOT above AND s.score = t.score)) THEN 1 ELSE 0 END) / any_value(ta), 6) AS retention,
    round(1 - sum(CASE WHEN NOT answerable AND (s.score > t.score OR (NOT above AND s.score = t.score)) THEN 1 ELSE 0 END) / any_value(tr), 6) AS rejection FROM t, s, tot GROUP BY 1, 2)"""
_LATEST = """latest AS (SELECT record_key, visited_at, synced_at, backup_id, visit_count, headword FROM history
  QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY visited_at DESC NULLS LAST, synced_at DESC NULLS LAST, backup_id DESC NULLS LAST, coalesce(visit_count, -1) DESC, coalesce(headword, '') DESC) = 1)"""

QUERIES = {f.__name__: f for f in (
    pass_rates, category_rollup, threshold_table, threshold_choice, threshold_pareto, shared_signatures, case_violations, latency_percentiles, nearest_rank, visit_counters, history_latest,
    history_newest, history_kept, backup_merge, cache_contents, user_sessions, order_balance, top_orders, event_runs, event_fill, event_depth, structure_histogram, headword_difference, hygiene,
    payload_integrity, article_owners, article_summary, media_urls, location_keys, english_hits, table_manifest,
)}
ORACLE = {
    "pass_rates": f"""WITH {_CASES}, g AS (SELECT category, count(*) AS cases, sum((label = 'answerable')::INT)::BIGINT AS answerable FROM c GROUP BY 1)
        SELECT category, cases, answerable, round((p + z * z / (2 * cases) - z * sqrt((p * (1 - p) + z * z / (4 * cases)) / cases)) / (1 + z * z / cases), 6) AS lower FROM (SELECT *, answerable / cases AS p, 1.959963984540054::DOUBLE AS z FROM g)""",
    "category_rollup": f"WITH {_CASES} SELECT split, category, grouping_id(split, category)::BIGINT AS level, count(*) AS cases, count(DISTINCT source) AS sources FROM c GROUP BY ROLLUP (split, category)",
    "threshold_table": f"WITH {_THRESHOLDS} SELECT threshold, above, retention, rejection FROM th",
    "threshold_choice": f"WITH {_THRESHOLDS} SELECT threshold, above, retention, rejection FROM th WHERE retention >= 0.95 ORDER BY rejection DESC, retention DESC, threshold DESC, above DESC LIMIT 1",
    "threshold_pareto": f"""WITH {_THRESHOLDS}, p AS (SELECT retention, max(rejection) AS rejection FROM th GROUP BY 1)
        SELECT retention, rejection FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.retention > p.retention AND q.rejection >= p.rejection)""",
    "shared_signatures": rf"WITH {_CASES} SELECT regexp_replace(lower(query), '[\s\pZ\pP\pS]', '', 'g') AS signature, count(DISTINCT split) AS splits FROM c WHERE query IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING splits > 1",
    "case_violations": f"""WITH {_CASES}, v AS (SELECT id, unnest(list_filter([CASE WHEN coalesce(trim(query), '') = '' THEN 'no query' END, CASE WHEN split IS NULL THEN 'no split' END,
        CASE WHEN coalesce(label, '') NOT IN ('answerable', 'reject') THEN 'unknown label' END, CASE WHEN label = 'answerable' AND len(targets) < 1 THEN 'answerable without target' END,
        CASE WHEN label = 'reject' AND len(targets) > 0 THEN 'reject with target' END], lambda x: x IS NOT NULL)) AS rule FROM c) SELECT rule, count(DISTINCT id) AS cases FROM v GROUP BY 1""",
    "latency_percentiles": "SELECT event_type, count(*) AS requests, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "nearest_rank": "SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = floor((n - 1) * 0.95)",
    "visit_counters": "SELECT record_key, sum(coalesce(visit_count, 0))::BIGINT AS count, epoch_us(min(visited_at)) AS first_at, epoch_us(max(visited_at)) AS last_at FROM (SELECT DISTINCT * FROM history) GROUP BY 1",
    "history_latest": f"WITH {_LATEST} SELECT record_key, epoch_us(visited_at) AS visited_at, epoch_us(synced_at) AS synced_at, backup_id, visit_count, headword FROM latest",
    "history_newest": f"WITH {_LATEST} SELECT split_part(record_key, ':', 1) AS dictionary, record_key, epoch_us(visited_at) AS visited_at, row_number() OVER (PARTITION BY split_part(record_key, ':', 1) ORDER BY latest.visited_at DESC, record_key)::INT AS place FROM latest QUALIFY place <= 100",
    "history_kept": f"WITH {_LATEST} SELECT record_key, headword FROM latest WHERE headword IS NOT NULL",
    "backup_merge": """WITH m AS (SELECT record_key, backup_id % 2 AS side, backup_id FROM history WHERE backup_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_key, backup_id % 2
          ORDER BY visited_at DESC NULLS LAST, synced_at DESC NULLS LAST, backup_id DESC NULLS LAST, coalesce(visit_count, -1) DESC, coalesce(headword, '') DESC) = 1)
        SELECT record_key, backup_id FROM m QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY side DESC) = 1""",
    "cache_contents": """WITH s AS (SELECT event_type, user_id, min(ts) AS created_at, max(ts) AS accessed_at FROM events GROUP BY 1, 2), n AS (SELECT event_type, max(ts) AS now_ FROM events GROUP BY 1)
        SELECT event_type, user_id, created_at, accessed_at, row_number() OVER (PARTITION BY event_type ORDER BY accessed_at DESC, created_at DESC, user_id DESC)::INT AS place
        FROM s JOIN n USING (event_type) WHERE created_at > now_ - INTERVAL 20 DAY QUALIFY place <= 50""",
    "user_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS began, max(ts) AS ended FROM s GROUP BY 1, 2""",
    "order_balance": "SELECT o_orderkey, o_custkey, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM orders",
    "top_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 8",
    "event_runs": """WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events),
        i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c) SELECT user_id, island, event_type, count(*) AS events FROM i GROUP BY ALL""",
    "event_fill": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events",
    "event_depth": """WITH r AS (SELECT *, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
        SELECT event_id, (run - least(0, min(run) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS depth FROM r""",
    "structure_histogram": "SELECT scope, section, semantic_role, resource_category, count(*) AS rows FROM search_documents GROUP BY ALL",
    "headword_difference": """WITH d AS (SELECT DISTINCT entry_id, headword FROM search_documents WHERE entry_id IS NOT NULL AND headword IS NOT NULL), e AS (SELECT DISTINCT id AS entry_id, headword FROM entries WHERE headword IS NOT NULL)
        SELECT entry_id, headword, 1::BIGINT AS missing, 0::BIGINT AS unexpected FROM (FROM d EXCEPT FROM e) UNION ALL SELECT entry_id, headword, 0, 1 FROM (FROM e EXCEPT FROM d)""",
    "hygiene": """WITH v AS (SELECT id, unnest(list_filter([CASE WHEN headword <> trim(headword, ' ') THEN 'outer space' END, CASE WHEN contains(headword, '  ') THEN 'double space' END, CASE WHEN headword = '' THEN 'empty' END,
        CASE WHEN coalesce(english_text, chinese_text, definition_text, candidate_text) IS NULL THEN 'no text' END, CASE WHEN owner_id IS NULL THEN 'no owner' END,
        CASE WHEN weight < 0 THEN 'negative weight' END], lambda x: x IS NOT NULL)) AS rule FROM search_documents) SELECT rule, count(DISTINCT id) AS documents FROM v GROUP BY 1""",
    "payload_integrity": "SELECT DISTINCT id, sha256(payload) AS digest, strlen(payload) = payload_size AS intact FROM etymology_articles WHERE payload IS NOT NULL",
    "article_owners": """WITH a AS (SELECT term_normalized, count(DISTINCT entry_id) AS owners, count(DISTINCT id) AS articles, count(DISTINCT position_no) AS positions FROM etymology_articles GROUP BY 1)
        SELECT owners, count(*) AS terms, sum(articles)::BIGINT AS articles, sum((positions < articles)::INT)::BIGINT AS clashing FROM a GROUP BY 1""",
    "article_summary": r"""WITH f AS (SELECT * FROM etymology_articles WHERE term_normalized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term_normalized ORDER BY position_no NULLS FIRST, id, imported_at DESC) = 1),
        l AS (SELECT term_normalized AS term, id, label, trim(regexp_replace(preview, '\s+', ' ', 'g')) AS line FROM f)
        SELECT term, id, CASE WHEN regexp_full_match(label, '\(.*\)') THEN trim(label[2:-2]) ELSE label END AS label, CASE WHEN length(line) > 512 THEN rtrim(substr(line, 1, 509)) || '...' ELSE line END AS preview FROM l""",
    "media_urls": r"""SELECT id, CASE WHEN strlen(headword) BETWEEN 1 AND 512 AND NOT regexp_matches(headword, '[/\\]') AND headword NOT IN ('.', '..')
        THEN 'https://media.example/' || url_encode(substr(lower(headword), 1, 1)) || '/' || url_encode(substr(lower(headword), 1, 3)) || '/' || url_encode(headword) || '.mp3' END AS url FROM entries""",
    "location_keys": """WITH d AS (SELECT DISTINCT id, entry_id, section, json_extract_string(path_json, '$[*]') AS p, owner_id FROM search_documents WHERE entry_id IS NOT NULL),
        f AS (SELECT entry_id, min_by(section, id) AS fs, min_by(p, id)[:2] AS fp, min_by(coalesce(owner_id, ''), id) AS fo FROM d GROUP BY 1)
        SELECT id, array_to_string([url_encode(s) FOR s IN p], '/') AS key, len(p)::INT AS depth,
          section = fs AND ((len(p) > len(fp) AND p[:len(fp)] = fp) OR (p = fp AND (fo = '' OR owner_id IS NULL OR fo = owner_id))) AS inside FROM d JOIN f USING (entry_id)""",
    "english_hits": """WITH d AS (SELECT DISTINCT id, headword, english_text FROM search_documents WHERE headword IS NOT NULL AND english_text IS NOT NULL),
        p AS (SELECT id, headword, [regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(t, '[ˈˌ]', '', 'g'), '[‐‑‒–—−]', '-', 'g')), '\\p{Han}', ' ', 'g'), '[^\\x00-\\x7F\\pL\\pN]', ' ', 'g') FOR t IN [headword, english_text]] AS t FROM d),
        k AS (SELECT id, headword, [regexp_extract_all(regexp_replace(regexp_replace(x, '([^\\x00-\\x7F][-'']{0,8})[a-z0-9]+', '\\1', 'g'), '[a-z0-9]+([-'']{0,8}[^\\x00-\\x7F])', '\\1', 'g'), '[a-z0-9]+') FOR x IN t] AS k FROM p),
        h AS (SELECT id, headword, list_distinct(k[1]) AS asked, k[2] AS there FROM k),
        n AS (SELECT id, headword, len(list_intersect(asked, there))::INT AS every, [w FOR w IN asked IF w NOT IN ('a', 'an', 'the', 'to', 'of', 'on', 'no', 'i', 'and', 'or')] AS strong, there FROM h)
        SELECT id, headword, CASE WHEN len(strong) > 0 THEN len(list_intersect(strong, there)) ELSE every END::INT AS significant, every FROM n""",
    "table_manifest": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES),
}
