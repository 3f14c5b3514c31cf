import datetime as dt
import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import markup
from glossa.operators import evaluate, index, islands, reverse, state, vectors
from glossa.operators.ordinals import numbered
from glossa.sources import corpus
from glossa.streaming import visits


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r.n for r in numbered(rows, "n", "k").orderBy("k").collect()] == list(range(1000))
    assert numbered(rows.limit(0), "n", "k").count() == 0


def _docs(spark, *texts):
    rows = [(i, f"e{i}", "sense", "h", t, "definition", 100) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "id long, entry_id string, scope string, headword string, chinese_text string, semantic_role string, weight int")


def _search(spark, docs, query):
    asked = spark.createDataFrame([(query, query)], "query_id string, query string")
    return [r.id for r in sorted(reverse.search(asked, docs).collect(), key=lambda r: (r.group_place, r.evidence_place))]


def test_reverse_search_of_known_texts(spark):
    silicon = _docs(spark, "硅是一种化学元素", "这块硅片用于测试", "硅常用于半导体材料", "硅谷是科技产业中心", "计算机是一种电子设备")
    assert _search(spark, silicon, "矽是一种化学元素")[0] == 1
    assert _search(spark, silicon, "abc") == []
    assert _search(spark, _docs(spark, "火山；肺病", "山肺"), "山肺") == [2]
    ranked = _search(spark, _docs(spark, "大雪休息日，大雪假", "休息；歇息", "间歇；休息"), "休息")
    assert ranked[:2] == [2, 3] and ranked[-1] == 1
    assert _search(spark, silicon.limit(0), "硅") == []


def test_document_rules(spark):
    docs = _docs(spark, "字", "abc", None).withColumns({"resource_category": F.lit(None).cast("string"), "section": F.lit("definitions"), "path_json": F.lit('["a"]')})
    found = {r.id: r.violations for r in index.document_violations(docs).collect()}
    assert found == {1: [], 2: ["chinese text"], 3: ["chinese text"]}


def test_quantising_rounds_both_ways(spark):
    v = F.array(*(F.lit(x).cast("float") for x in (0.5 / 127, 1.5 / 127, -0.5 / 127, 2.0)))
    assert spark.range(1).select(vectors.quantised_document(v).alias("x")).first().x == [0, 2, 0, 127]
    q = F.array(F.lit(3.0), F.lit(4.0))
    assert spark.range(1).select(vectors.quantised_query(q).alias("x")).first().x == [76, 102]


def test_vector_matches_respect_scopes_and_ties(spark):
    rows = spark.createDataFrame([(0, [127, 0], 1), (1, [110, 20], 2), (2, [0, 127], 1), (3, [-127, 0], 16), (4, [110, 20], 2)], "id long, v array<int>, scope_mask int")
    asked = spark.createDataFrame([("s", [127, 0], 1), ("all", [127, 0], 31)], "query_id string, q array<int>, scope_mask int")
    found = vectors.top_matches(asked, rows, 3, mask=True).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.place) if r.query_id == "s"] == [0, 2]
    assert [r.id for r in sorted(found, key=lambda r: r.place) if r.query_id == "all"] == [0, 1, 4]
    assert vectors.top_matches(asked, rows.limit(0), 3, mask=True).count() == 0
    assert vectors.pool_size(0, 20) == 504 and vectors.pool_size(500, 50) == 4096


def test_fused_order(spark):
    lexical = spark.createDataFrame([("q", "a", 4, 1), ("q", "b", 1, 2)], "query_id string, entry_id string, tier int, place int")
    p = "array<struct<band:int,ans:int,sig:int,all:int>>"
    semantic = spark.createDataFrame([("q", "b", [(5, 2, 0, 0)], 2), ("q", "c", [(5, 2, 0, 0), (1, 2, 0, 0)], 1)], f"query_id string, entry_id string, profile {p}, place int")
    assert [r.entry_id for r in vectors.fused(lexical, semantic).orderBy("place").collect()] == ["a", "c", "b"]


def test_metrics(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, item string, place int")
    relevant = spark.createDataFrame([("q", "b", 3), ("q", "z", 2), ("n", "x", 2)], "query_id string, item string, grade int")
    by = {r.query_id: r for r in evaluate.ranked_metrics(results, relevant, 3).collect()}
    ideal = 7 / math.log2(2) + 3 / math.log2(3)
    assert by["q"].ndcg == pytest.approx(7 / math.log2(3) / ideal) and by["q"].reciprocal_rank == 0.5 and by["q"].recall == 0.5
    assert by["n"].ndcg == 0 and by["n"].hits == 0


def test_calibration(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.5, False)], "score double, answerable boolean")
    best = evaluate.calibrated(evaluate.thresholds(rows), 0.95).first()
    assert (best.threshold, best.above, best.retention, best.rejection) == (0.6, False, 1.0, 0.5)
    front = {(round(r.retention, 3), r.rejection) for r in evaluate.pareto(evaluate.thresholds(rows)).collect()}
    assert front == {(1.0, 0.5), (0.667, 1.0)}


def test_islands_and_depth(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate("aab(()))(c")], "i int, c string").withColumn("k", F.lit(1))
    runs = islands.islands(rows.withColumn("new", islands.changes("c", ["k"], ["i"])), ["k"], ["i"], F.col("new"))
    assert [r.island for r in runs.orderBy("i").collect()] == [1, 1, 2, 3, 3, 4, 4, 4, 5, 6]
    deep = islands.with_depth(rows, F.col("c") == "(", F.col("c") == ")", ["k"], ["i"])
    assert [r.depth for r in deep.orderBy("i").collect()] == [0, 0, 0, 1, 2, 1, 0, 0, 1, 1]


def test_multiset_difference(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    right = spark.createDataFrame([("a",), ("c",)], "v string")
    assert {tuple(r) for r in islands.multiset_difference(left, right, ["v"]).collect()} == {("a", 1, 0), ("b", 1, 0), ("c", 0, 1)}


def test_state(spark):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    log = spark.createDataFrame([("c", k, t(s)) for k, s in (("a", 0), ("b", 50), ("a", 100), ("d", 90), ("e", 95))], "cache string, k string, at timestamp")
    held = state.cache_replay(log, "cache", "k", "at", 60, 2)
    assert [r.k for r in held.orderBy("place").collect()] == ["e", "d"]
    rows = spark.createDataFrame([("x", 1, "old"), ("x", 2, None), ("y", 1, "kept")], "k string, v int, note string")
    assert {(r.k, r.note) for r in state.latest(rows, ["k"], [F.col("v")]).collect()} == {("x", None), ("y", "kept")}
    assert [r.k for r in state.without_deleted(rows, ["k"], [F.col("v")], F.col("note").isNull()).collect()] == ["y"]


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("1", "w", '{"pos": [{"value": "noun"}, {"value": "noun"}], "s": [{"def_simp": [{"value": "字典"}, {"text": "释义"}]}]}'), ("2", "x", "{"), ("3", None, "{}")], "id string, word string, word_body string")
    good, bad = corpus.source_entries(rows)
    assert [r.id for r in bad.orderBy("id").collect()] == ["2", "3"]
    made = corpus.projected_entries(good).first()
    assert made.parts_of_speech == ["noun"] and made.translation_preview == "字典释义"
    path = tmp_path / "docs.jsonl"
    path.write_text('{"entryId": "b", "scope": "sense", "location": {"path": ["p"]}}\n{"entryId": "a", "unknown": 1}\nnot json\n')
    docs, refused = corpus.read_documents(spark, str(path))
    assert [r.entryId for r in docs.collect()] == ["b"] and refused.count() == 2
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("x/Cat.mp3", "dog.mp3", "y/dog.ogg", "__MACOSX/cat.mp3"):
            z.writestr(name, b"")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    assert [(r.key, r.member) for r in corpus.archive_members(spark, str(tmp_path / "a.zip")).collect()] == [("cat", "x/Cat.mp3")]
    manifest = spark.createDataFrame([("a.zip", len(buffer.getvalue()), "0"), ("gone", 1, "0")], "name string, bytes long, sha256 string")
    assert {tuple(r) for r in corpus.manifest_faults(spark, manifest, str(tmp_path)).collect()} == {("a.zip", "digest"), ("gone", "missing")}
    named = spark.createDataFrame([("Alpha", '["501","9"]'), ("Beta", '["501"]')], "word string, word_ids string")
    articles = spark.createDataFrame([(501, "alpha", "p"), (502, "lone", "q")], "id long, word string, payload string")
    assert {(r.term, r.article_id) for r in corpus.article_rows(named, articles).collect()} == {("alpha", "501"), ("beta", "501"), ("lone", "502")}
    assert {tuple(r) for r in corpus.article_faults(named, articles).collect()} == {("missing", "9"), ("shared", "501")}


def test_markup():
    blocks = markup.blocks_of('<p>a <span>b</span><!-- c --><a href="/word/x">d &amp; e</a></p><blockquote>q</blockquote>')
    assert [b["kind"] for b in blocks] == ["paragraph", "quote"]
    assert [(r["text"], r["marks"], r["href"]) for r in blocks[0]["runs"]] == [("a ", [], None), ("b", ["foreign"], None), ("d & e", [], "/word/x")]
    assert markup.blocks_of("<table></table>") is None


def test_streams(spark, tmp_path):
    t = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    schema = "id long, k string, at timestamp"
    parts = [[(1, "a", t(0)), (1, "a", t(0)), (2, "b", t(1))], [(3, "a", t(30)), (4, "a", t(80))], [(5, "z", t(200))], [(6, "z", t(201))]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("windows", visits.visit_windows(events, "k", "at", "id")), ("ended", visits.expiring(events, "k", "at", "24 hours"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert {(r.k, r.visits) for r in spark.table("windows").collect()} >= {("a", 1), ("b", 1)}
    assert {r.k for r in spark.table("ended").collect()} >= {"a", "b"}


def test_a_plan_of_matches_does_not_grow_with_the_blocks_of_queries(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-127, 128, 8).tolist()) for i in range(300)]
    vectors_ = spark.createDataFrame(rows, "id long, v array<int>")
    asked = vectors_.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    one = vectors.top_matches(asked, vectors_, 5)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 25)
    many = vectors.top_matches(asked, vectors_, 5)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(many) == size(one)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) and many.count() == 1500
