import numpy as np

from glossa import constants as C
from glossa.operators import vectors
from glossa.plans import semantic_queries as S

DOCS = "id long, entry_id string, headword string, scope string, semantic_role string, english_text string, chinese_text string, section string, part string, owner_id string, path_json string, weight int, text_id long, imported_at int"


def _folder(spark, path, texts, vectors, docs):
    """A data directory of texts, all of one scope, with their vectors by id, and documents as (entry, role, text id[, owner])."""
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, normalized_chinese_text string, scope_mask int").write.parquet(f"{path}/texts.parquet")
    v = np.zeros((len(texts), 64), dtype=np.int8)
    v[:, :2] = vectors
    spark.createDataFrame([(0, len(texts), v.tobytes())], "first_vector_id long, vector_count int, data binary").write.parquet(f"{path}/vector_blocks.parquet")
    rows = [(i, e, "h", "sense", role, None, texts[t], "definitions", "", owner[0] if owner else f"o{i}", '["a"]', 100, t, 0) for i, (e, role, t, *owner) in enumerate(docs)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/search_documents.parquet")
    return str(path)


def test_hybrid_fuses_whole_windows(spark, tmp_path):
    n = 49
    sf = _folder(spark, tmp_path, ["山坡上的陶工"] * n, [(127, 0)] * n, [(f"e{i:02}", "definition", i) for i in range(n)])
    found = S.hybrid_search(spark, sf).collect()
    assert sorted(r.place for r in found) == list(range(1, n + 1))
    assert sorted(r.lexical_place for r in found) == sorted(r.semantic_place for r in found) == list(range(1, n + 1))


def test_groups_hold_the_evidence_of_the_whole_pool(spark, tmp_path):
    r = np.random.default_rng(6)
    n, roles = 120, list(C.RETRIEVAL_ROLE)
    x = r.integers(60, 128, (n, 2))
    sf = _folder(spark, tmp_path, [f"句{i}" for i in range(n)], x, [(f"e{r.integers(30):02}", roles[r.integers(7)], int(r.integers(n))) for _ in range(600)])
    docs = spark.read.parquet(f"{sf}/search_documents.parquet").collect()
    want = set()
    for q in (0, 50, 100):
        dots = [int(a) for a in x @ x[q]]
        band = [round(float(np.float32(d / C.DOT_SCALE)) / C.BAND_WIDTH) for d in dots]
        order = lambda ranks: lambda d: (-band[d.text_id], -ranks[d.semantic_role], -dots[d.text_id], d.entry_id, d.id)  # noqa: B023, E731
        first = list(dict.fromkeys(d.entry_id for d in sorted(docs, key=order(C.RETRIEVAL_ROLE))))[:20]
        for place, e in enumerate(first, 1):
            best = sorted((d for d in docs if d.entry_id == e), key=order(C.EVIDENCE_ROLE))[:8]
            want |= {(q, place, k, e, d.id, dots[d.text_id]) for k, d in enumerate(best, 1)}
    assert {tuple(g) for g in S.semantic_groups(spark, sf).collect()} == want


def test_roles_decide_between_matches_of_a_band(spark, tmp_path):
    docs = [("p", "expression", 0), ("w", "definition", 0), ("x", "definition", 1), ("x", "qualifier", 2), ("y", "definition", 1), ("y", "definition", 2)]
    sf = _folder(spark, tmp_path, ["山坡上的陶工", "木桶", "书架"], [(127, 0)] * 3, docs)
    found = sorted(S.hybrid_search(spark, sf).collect(), key=lambda r: r.place)
    assert [(r.entry_id, r.tier) for r in found] == [("w", 4), ("y", None), ("x", None), ("p", None)]


def test_matches_of_one_key_merge(spark):
    schema = "query_id int, entry_id string, id long, key string, role int, evidence_role int, protecting boolean, tier int, lexical_at int, lexical_place int, dot int, semantic_at int, semantic_place int"
    lexical = [(1, "a", 10, "k", 2, 3, True, 3, 1, 7, None, None, None), (1, "a", 11, "m", 2, 3, True, 1, 2, 7, None, None, None), (1, "l", 12, "k", 2, 3, True, 4, 1, 8, None, None, None)]
    semantic = [(1, "a", 13, "k", 1, 1, False, None, None, None, 16129, 1, 2), (1, "a", 14, "n", 1, 1, False, None, None, None, 9000, 2, 2), (1, "s", 15, "k", 1, 1, False, None, None, None, 16129, 1, 3), (1, "s", 16, "k", 1, 1, False, None, None, None, 16129, 2, 3)]
    many = [(1, "t", 20 + i, f"s{i}", 2, 3, True, 4, i, 9, None, None, None) for i in range(1, 9)] + [(1, "t", 30, "z", 2, 3, True, None, None, None, 16129, 1, 4)]
    merged = vectors.merged_matches(spark.createDataFrame(lexical + semantic + many, schema))
    got = {(r.entry_id, r.key, r.strong, r.dot, r.answer) for r in merged.collect() if r.entry_id == "a"}
    assert got == {("a", "k", 3, 16129, 2), ("a", "m", None, None, 2), ("a", "n", None, 9000, 1)}
    by = {r.entry_id: r for r in vectors.profiled(merged).collect()}
    assert [tuple(e)[:2] for e in by["a"].profile] == [(200, 2), (112, 1)] and (by["a"].tier, by["a"].scores, by["a"].lexical_place, by["a"].semantic_place) == (3, [16129, 9000], 7, 2)
    assert len(by["s"].profile) == 2 and by["l"].profile is None and by["l"].tier == 4
    assert by["t"].profile is None and by["t"].tier == 4 and by["t"].semantic_place == 4


def test_only_rows_of_the_first_entries_are_ranked(spark):
    """Pools that name enough entries at once and pools that don't; no window over all rows of a query is in the plan of the ranked rows."""
    matches = spark.createDataFrame([(q, t, 16129 - 90 * t * (q + 1), t + 1) for q in (0, 1) for t in range(30)], "query_id int, id long, dot int, place int")
    rows = [(t, 100 * t + j, f"e{(t * j) % 9 if t % 3 else 0}", "h", j, 2, 3) for t in range(30) for j in range(4)]
    found = vectors.evidence_groups(matches, spark.createDataFrame(rows, "text_id long, id long, entry_id string, headword string, weight int, role int, evidence_role int"), "text_id", 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [x.split(",")[1].strip() for x in plan.split("windowspecdefinition(")[1:]]
    assert windows and all(x.startswith("entry_id#") for x in windows)
    want = set()
    for q in (0, 1):
        mine = [(d.dot, round(float(np.float32(d.dot / C.DOT_SCALE)) / C.BAND_WIDTH), *r) for d in matches.filter(f"query_id = {q}").collect() for r in rows if r[0] == d.id]
        mine.sort(key=lambda x: (-x[1], -x[0], -x[6], x[4], x[3]))
        for place, e in enumerate(list(dict.fromkeys(x[4] for x in mine))[:4], 1):
            want |= {(q, place, k, e, x[3], x[0]) for k, x in enumerate([x for x in mine if x[4] == e][:8], 1)}
    assert {tuple(r) for r in found.collect()} == want
