import random

from pyspark.sql import functions as F

from glossa.operators import pools, reverse

SCHEMA = "id long, entry_id string, scope string, headword string, english_text string, chinese_text string, semantic_role string, weight int"


def test_pools_equal_those_of_all_pairs_and_no_pair_is_shuffled(spark, monkeypatch):
    """Shelves and blocks of few rows, pools that are cut: what is found equals the pools cut from every pair."""
    monkeypatch.setattr(pools, "SHELF", 25)
    monkeypatch.setattr(pools, "QUERY_BLOCK", 4)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("甲乙丙丁戊 ") for _ in range(n))
    rows = [(i, f"e{i % 30}", r.choice(["sense", "example", "resource", None]), r.choice(["put off", "inputs", "x"]), None, text(r.randrange(1, 12)), "definition", r.choice([None, -5, 7, 30])) for i in range(200)]
    asked = reverse.prepared_queries(spark.createDataFrame([(q, q) for q in ["甲", "甲乙", "乙丙丁", "put 甲乙", "off 丙", "丁戊甲乙", "put", "甲乙丙 丁"]], "query_id string, query string")).withColumn("least", F.lit(2))
    docs = reverse.prepared_documents(spark.createDataFrame(rows, SCHEMA))
    limit = 6
    made = pools.Pools(asked.select("query_id", "tokens", "words", "least"), docs, limit)
    named = docs.select("id", F.lower(F.concat_ws(" ", "headword", F.coalesce("english_text", F.lit("")), "chinese_text")).alias("name"))
    met = reverse.candidates(asked, docs).join(asked.select("query_id", "n_tokens", "words"), "query_id").join(named, "id").filter(F.forall("words", lambda w: F.contains("name", w)))
    some = lambda df: sorted((x.query_id, x.id, x.pool) for x in df.collect())
    want = some(reverse.pooled(met.filter("every and n_tokens > 1"), limit))
    assert want and some(made.whole()) == want
    settled = spark.createDataFrame([("甲乙", 3), ("put 甲乙", 1)], "query_id string, pool int")
    want = some(reverse.pooled(met.join(settled, ["query_id", "pool"], "left_anti"), limit).filter("shared >= 2"))
    assert want and some(made.near(settled)) == want


def test_queries_with_a_rare_word_find_what_all_pairs_give(spark):
    """Words that stand inside others, in one field or several, or nowhere; the query whose word is in too many documents is left to the shelves."""
    r = random.Random(6)
    text = lambda n: "".join(r.choice("甲乙丙丁戊 ") for _ in range(n))
    rows = [(i, f"e{i % 30}", r.choice(["sense", "example", "resource", None]), r.choice(["Put-off", "inputs", "x", "offer no", None]), r.choice([None, "no offer", "z9"]), text(r.randrange(1, 12)) + r.choice(["", "x"]), "definition", r.choice([None, -5, 7])) for i in range(200)]
    queries = ["put 甲乙", "off 丙", "put off 乙丙", "no put 甲", "nowhere 甲", "z9 no 乙丙丁", "x 甲", "offer", "甲乙"]
    asked = reverse.prepared_queries(spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")).withColumn("least", F.lit(2)).filter("size(words) > 0")
    docs = reverse.prepared_documents(spark.createDataFrame(rows, SCHEMA))
    named = docs.select("id", F.lower(F.concat_ws(" ", "headword", "english_text", "chinese_text")).alias("name"))
    hold = named.crossJoin(asked.select("query_id", F.explode("words").alias("word"))).filter(F.contains("name", "word")).groupBy("query_id", "word").agg(F.countDistinct("id").alias("documents"))
    most = {x.query_id: x.documents for x in hold.groupBy("query_id").agg(F.min("documents").alias("documents")).collect()}
    limit = most["put 甲乙"] + 20
    met, rare = pools.by_word(asked.select("query_id", "tokens", "words", "least"), docs, limit)
    there = {x.query_id for x in rare.collect()}
    assert "x 甲" not in there and {"put 甲乙", "put off 乙丙", "nowhere 甲", "offer"} <= there and all(most.get(q, 0) <= limit for q in there)
    want = reverse.candidates(asked, docs).join(asked.select("query_id", "n_tokens", "words"), "query_id").join(named, "id").filter(F.forall("words", lambda w: F.contains("name", w))).filter(F.col("query_id").isin(*there))
    want = sorted((x.query_id, x.id, x.pool, x.shared, x.n_tokens) for x in want.collect())
    assert want and sorted((x.query_id, x.id, x.pool, x.shared, x.n) for x in met.collect()) == want
