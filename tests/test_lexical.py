from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.functions import phrases, typo
from glossa.functions import text as X
from glossa.operators import english, index, lexical

ENTRIES = [
    ("two", "alpha zoo"), ("one", "Alpha able"), ("exact", "alpha"), ("grateful", "grateful"), ("gratefyl", "gratefyl"), ("gratitude", "gratitude"), ("terribly", "ter·ribly"), ("adams", "Adam’s apple"),
    ("ack-phrase", "acknowledgement of country"), ("ack-verb", "ac·know·ledge"), ("ack-noun", "acknowledgment"), ("the", "the"), ("put", "put through"), ("nothing", None), ("blank", ""),
]


def _index(spark):
    entries = spark.createDataFrame(ENTRIES, "id string, headword string")
    terms = index.entry_terms(entries, "id", "headword").cache()
    return entries, terms, index.term_deletes(terms)


def _ask(spark, *texts):
    return spark.createDataFrame([(t, t) for t in texts], "query_id string, query string")


def _ids(df, query):
    return [r.entry_id for r in sorted(df.filter(F.col("query_id") == query).collect(), key=lambda r: r.place)]


def test_suggestions_of_known_words(spark):
    entries, terms, deletes = _index(spark)
    found = lexical.suggestions(_ask(spark, "graeteful", "grateul", "gratefel", "grat", "zz", "acknowl", "Adam's", "ALPHA"), terms, deletes, entries).cache()
    assert _ids(found, "graeteful") == ["grateful"]
    assert _ids(found, "grateul") == ["grateful"]
    assert _ids(found, "gratefel") == ["grateful", "gratefyl"]
    assert _ids(found, "grat") == ["grateful", "gratefyl", "gratitude"]
    assert _ids(found, "zz") == []
    assert _ids(found, "acknowl")[:1] == ["ack-verb"] and _ids(found, "acknowl")[-1] == "ack-phrase"
    assert _ids(found, "Adam's") == ["adams"]
    assert _ids(found, "ALPHA") == ["exact", "two", "one"] or _ids(found, "ALPHA")[0] == "exact"


def test_direct_candidates_come_before_signatures(spark):
    entries = spark.createDataFrame([("teh-e", "tech"), ("the-e", "the"), ("he-e", "he")], "id string, headword string")
    terms = index.entry_terms(entries, "id", "headword")
    found = lexical.typo_matches(_ask(spark, "teh"), terms, index.term_deletes(terms), entries)
    ranks = {r.entry_id: r.rank for r in found.collect()}
    assert ranks["the-e"] == 1 and ranks["teh-e"] > ranks["the-e"]


def test_deletes_match_brute_force(spark):
    words = ["abc", "aab", "aaaa", "ab", "x"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", typo.deletes(F.col("w")).alias("d"), typo.direct_candidates(F.col("w")).alias("c")).collect()
    for r in rows:
        drops = list(dict.fromkeys(r.w[:i] + r.w[i + 1 :] for i in range(len(r.w))))
        swaps = [r.w[:i] + r.w[i + 1] + r.w[i] + r.w[i + 2 :] for i in range(len(r.w) - 1) if r.w[i] != r.w[i + 1]]
        assert r.d == drops and r.c == list(dict.fromkeys(swaps + drops))


def test_empty_sides(spark):
    entries, terms, deletes = _index(spark)
    assert lexical.suggestions(_ask(spark).limit(0), terms, deletes, entries).count() == 0
    assert lexical.suggestions(_ask(spark, "a"), terms.limit(0), deletes.limit(0), entries).count() == 0


def test_pages(spark):
    rows = spark.createDataFrame([("q", i) for i in range(5)] + [("r", 0)], "query string, n int")
    page = lexical.page(rows, "query", ["n"], 2, 2).collect()
    assert [(r.n, r.has_more, r.next_offset) for r in sorted(page, key=lambda r: r.n)] == [(2, True, 4), (3, True, 4)]
    assert [(r.n, r.has_more, r.next_offset) for r in lexical.page(rows, "query", ["n"], 4, 2).collect()] == [(4, False, None)]


def _plan(spark, *queries):
    _, terms, _ = _index(spark)
    out = english.plan(_ask(spark, *queries), terms)
    by = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.place)):
        by.setdefault(r.query_id, []).append((r.kind, r.text))
    return by


def test_plan_of_queries(spark):
    by = _plan(spark, "put me through", "teh", "alpha zoo", "the alpha grateful")
    assert by["put me through"] == [("phrase", "put through")]
    assert by["teh"] == [("correction", "the")]
    assert by["alpha zoo"] == [("exact", "alpha zoo")]
    assert by["the alpha grateful"] == [("word", "alpha"), ("word", "grateful")]


def test_phrase_terms_and_distance():
    assert phrases.index_terms("take (sth) off/away")[:1] == ["take sth off away"]
    assert {"take off", "take away"} <= set(phrases.index_terms("take (sth) off/away"))
    assert phrases.distance("put me through", "put sb through") == 0
    assert phrases.distance("put it through", "put sb through") == 1
    assert phrases.distance("", "x") == 64
    assert phrases.words("éab cd Öx-yz e-é 中ab") == ["cd", "ab"]


@given(st.text("ab ()/,sb", max_size=30))
def test_phrase_terms_are_bounded_and_distinct(value):
    found = phrases.index_terms(value)
    assert len(found) <= 24 and len(set(found)) == len(found)


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert get(X.spaced(lit("Ａ，矽　肺"))) == "Ａ 硅 肺"
    assert get(X.cjk_runs(lit("火山；肺病 ab"))) == ["火山", "肺病"]
    assert get(X.longest_common(lit("火山硅肺病"), X.cjk_runs(lit("一种严重硅肺病")))) == 3
    assert get(X.query_tokens(X.cjk_runs(lit("火山；肺")))) == ["火山", "肺"]
    assert get(X.only_in_brackets(lit("（休息）睡(休息)"), lit("休息"))) is False
    assert get(X.only_in_brackets(lit("(休息)睡"), lit("休息"))) is True
    assert get(X.only_in_brackets(lit("(休息)休息"), lit("休息"))) is False
    assert get(X.headword_tokens(lit("ˈWell-known mother's Öx cd"))) == ["well-known", "mother's", "cd"]
    assert [r.text for r in get(X.metadata_labels(lit("[Ox3000] [CEFR_A1] [OPAL_W] [CET4] [zz]")))] == ["3000", "A1", "W", "CET4"]
    assert get(X.label_weight(X.metadata_labels(lit("[Ox3000][CEFR_A1]")))) == 200
    assert get(X.reference_kind(lit("-> See  also"))) == "see-also" and get(X.reference_kind(lit("q"))) == "generic"
    assert get(X.prefixed_category(lit("which word note"), [("WHICH WORD", "which-word")])) == "which-word"
    assert get(X.media_url(lit("a b"), "https://m.example/{prefix1}/{key}")) == "https://m.example/a/a%20b"
    assert get(X.media_url(lit("../x"), "https://m.example/{key}")) is None
    assert tuple(get(X.link_target(lit("/word/a%20b#7")))) == ("a b", "7") and get(X.link_target(lit("https://x.example/"))) is None
    assert get(X.stems(lit("tried"))) == ["try"] and get(X.stems(lit("running"))) == ["run"] and get(X.stems(lit("glass"))) == ["glas"]
    assert get(X.token_at(lit("say don't now"), lit(6))) == "don't" and get(X.token_at(lit("a  b"), lit(2))) is None
    assert get(X.preview(lit("a  b" * 400))).endswith("...") and len(get(X.preview(lit("x" * 600)))) == 512
    assert get(X.evidence_hits(F.array(lit("the"), lit("cat")), lit("The cat sat"))) == (1, 2)
    assert get(X.location_contains(lit("s"), F.array(lit("a")), lit(None).cast("string"), lit("s"), F.array(lit("a"), lit("b")), lit("o"))) is True
