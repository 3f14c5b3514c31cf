import random

import pytest
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.functions import text as X
from glossa.operators import reverse
from glossa.plans import reverse_queries

SCHEMA = "id long, entry_id string, scope string, headword string, english_text string, chinese_text string, semantic_role string, weight int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, e, s, h, en, zh, "definition", w) for i, (e, s, h, en, zh, w) in enumerate(rows, 1)], SCHEMA)


def _search(spark, docs, query, **more):
    asked = spark.createDataFrame([(query, query)], "query_id string, query string")
    return [r.id for r in sorted(reverse.search(asked, docs, **more).collect(), key=lambda r: (r.group_place, r.evidence_place))]


def test_headwords_in_a_query_are_anchors(spark):
    docs = _docs(spark, [("a", "sense", "put off", "delay", "推迟会议", 100), ("b", "sense", "delay", "", "推迟", 100), ("c", "sense", "offer", "put off", "推迟", 90), ("d", "sense", "put", "", "放置", 10)])
    assert _search(spark, docs, "put off 推迟") == [1, 4, 3]
    assert _search(spark, docs, "put off") == [1, 4]
    assert _search(spark, docs, "推迟")[0] in (2, 3) and set(_search(spark, docs, "推迟")) == {1, 2, 3}
    assert _search(spark, docs, "nowhere 推迟") == [] and _search(spark, docs, "...") == []


def test_tiers_without_a_whole_match_are_searched_for_parts(spark):
    docs = _docs(spark, [("a", "sense", "h", None, "化学元素", 100), ("b", "sense", "h", None, "化学品", 100), ("c", "example", "h", None, "元素周期化学", 100), ("d", "resource", "h", None, "化学元", 100)])
    found = _search(spark, docs, "化学元素")
    assert found[0] == 1 and 2 not in found and 4 in found


def test_compatibility_forms_match(spark):
    docs = _docs(spark, [("a", "sense", "h", None, "⼤雪休息⽇", 100)])
    assert _search(spark, docs, "大雪休息日", normal=X.compatible) == [1]


def test_anchor_terms(spark):
    rows = spark.createDataFrame([("Put-off it, the big 山 cat's",), ("the of",), ("éab cd",), ("山",)], "v string")
    assert [r.a for r in rows.select(X.anchor_terms(F.col("v")).alias("a")).collect()] == [["put-off it", "put-off", "it", "the big", "big", "cat's"], ["the of", "the", "of"], ["cd"], []]


def _inside(v, q):
    depth, inside, outside = 0, False, False
    for i, c in enumerate(v):
        if c in C.OPENING:
            depth += 1
        elif c in C.CLOSING:
            depth = max(0, depth - 1)
        elif v.startswith(q, i):
            inside, outside = inside or depth > 0, outside or depth == 0
    return inside and not outside


def test_measures_equal_plain_ones(spark):
    r = random.Random(7)
    rows = []
    for _ in range(400):
        text = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
        rows.append((text(r.randrange(1, 7), "甲乙丙"), [text(r.randrange(1, 9), "甲乙丙丁") for _ in range(r.randrange(1, 4))], text(r.randrange(0, 14), "甲乙([【）)】")))
    df = spark.createDataFrame(rows, "q string, runs array<string>, v string")
    q, runs = F.col("q"), F.col("runs")
    got = df.select("q", "runs", "v", X.longest_common(q, runs).alias("l"), X.leading_coverage(q, runs).alias("lead"), X.only_in_brackets(F.col("v"), q).alias("b")).collect()
    for x in got:
        parts = [x.q[i:j] for i in range(len(x.q)) for j in range(i + 1, len(x.q) + 1) if any(x.q[i:j] in run for run in x.runs)]
        assert x.l == max(map(len, parts), default=0)
        assert x.lead == pytest.approx(max((k for k in range(1, len(x.q) + 1) if any(x.q[:k] in run for run in x.runs)), default=0) / len(x.q))
        assert x.b == _inside(x.v, x.q), (x.v, x.q)


def test_stems(spark):
    want = {"falling": ["fal"], "stopped": ["stop"], "boxes": ["box"], "seeing": ["see", "seee"], "grass": ["gras"], "tried": ["try"], "cries": ["cry"], "ring": [], "as": [], "naïves": [], "used": []}
    rows = spark.createDataFrame([(w,) for w in want], "w string").select("w", X.stems(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == want


def test_every_entry_is_a_mixed_query(spark, tmp_path):
    """Whatever its id, and an entry without a headword or a preview has none."""
    entries = [("lx000000001", "glarn", "推迟"), ("lx000000050", "tofib", "推迟"), ("lx", "put off", "休息"), ("lx000000002", None, "休息"), ("lx000000003", "nith", None)]
    spark.createDataFrame(entries, "id string, headword string, translation_preview string").write.parquet(str(tmp_path / "entries.parquet"))
    rows = [("lx000000001", "sense", "glarn", "", "推迟", 100), ("lx000000050", "sense", "tofib", "", "推迟", 90), ("lx", "sense", "put off", "", "休息", 100), ("lx000000003", "sense", "nith", "", "推迟", 10)]
    _docs(spark, rows).withColumns({"candidate_text": F.lit(None).cast("string"), "definition_text": F.lit(None).cast("string"), "imported_at": F.lit(0)}).write.parquet(str(tmp_path / "search_documents.parquet"))
    found = {}
    for r in sorted(reverse_queries.reverse_search(spark, str(tmp_path)).collect(), key=lambda r: (r.group_place, r.evidence_place)):
        found.setdefault(r.query_id, []).append(r.id)
    assert found == {"推迟": [1, 2, 4], "休息": [3], "glarn 推迟": [1], "tofib 推迟": [2], "put off 休息": [3]}
