import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from glossa.functions import phrases
from glossa.operators import canonical, judging, requests
from glossa.streaming import visits


def test_routes(spark):
    rows = [
        ("a", "休息", "hybrid", None, None, None, None), ("b", "休", "hybrid", None, "sense,form", "256", "511"), ("c", "休息", None, None, "", None, None), ("d", "休息", None, None, "sense, form", None, None),
        ("e", "rest", None, "true", None, "51", None), ("f", " rest ", None, "true", None, "50", "x"), ("g", "rest", None, "yes", None, None, None), ("h", "  ", "x", None, None, None, None),
        ("i", "", None, None, None, None, None), ("j", "x" * 201, None, None, None, None, None), ("k", "rest", None, None, "sense", None, None), ("l", None, None, None, None, None, None), ("m", "休息", None, None, None, "7", "-1"),
    ]
    df = spark.createDataFrame(rows, "request_id string, q string, mode string, submitted string, scope string, limit string, offset string")
    got = {r.request_id: (r.route, r.error, r.limit, r.offset, r.scopes) for r in requests.routed(df).collect()}
    every = "sense,phrase,form,example,resource"
    assert got == {
        "a": ("hybrid", None, 32, 0, every), "b": ("reverse", None, 256, 511, "sense,form"), "c": ("none", None, None, None, None), "d": (None, "invalid_scope", None, None, None),
        "e": (None, "invalid_limit", None, None, None), "f": ("plan", None, 50, None, None), "g": (None, "invalid_submitted", None, None, None), "h": (None, "invalid_mode", None, None, None),
        "i": (None, "invalid_query", None, None, None), "j": (None, "query_too_long", None, None, None), "k": (None, "invalid_scope", None, None, None), "l": (None, "invalid_query", None, None, None), "m": (None, "invalid_offset", None, None, None),
    }


def test_entries_and_fingerprints(spark):
    entries = spark.createDataFrame([("1", "Adam’s apple"), ("2", "zoo")], "id string, headword string")
    articles = spark.createDataFrame([("adam's apple", "x", "l", "p", 1), ("adam's apple", "w", "l", "p", 0)], "term string, id string, label string, preview string, position int")
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("",), ("y" * 513,), (None,)], "id string")
    found = {r.id: (r.status, [a.id for a in r.articles or []]) for r in requests.entries_by_id(ids, entries, articles).collect()}
    assert found == {"1": ("ok", ["w", "x"]), "2": ("ok", []), "3": ("entry_not_found", []), "": ("invalid_id", []), "y" * 513: ("invalid_id", []), None: ("invalid_id", [])}
    prints = [tuple(requests.fingerprint(d).first()) for d in (entries, entries.repartition(3).orderBy(F.desc("id")), entries.union(entries.limit(1)), entries.limit(0))]
    assert prints[0] == prints[1] and len(set(prints)) == 3


def test_digests_and_parts(spark):
    row = spark.createDataFrame([("查询", ["Noun", " noun", None, "verb"], ["adj."])], "q string, p array<string>, o array<string>").select(
        canonical.hmac_sha256(b"key", F.col("q")).alias("h"), canonical.distinct_parts(F.col("p")).alias("d"), canonical.unambiguous_part(F.col("p")).alias("n"), canonical.unambiguous_part(F.col("o")).alias("u")
    )
    assert tuple(row.first()) == (hmac.new(b"key", "查询".encode(), hashlib.sha256).hexdigest(), ["Noun", "verb"], None, "adj.")


def test_preferred_and_overlay(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, item string, place int")
    preferred = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("none", "z", 1)], "query_id string, item string, tier int")
    got = {r.query_id: r for r in judging.preferred_metrics(results, preferred).collect()}
    assert (got["q"].width, got["q"].first, got["q"].prefix_set, got["q"].prefix_order) == (2, False, True, False)
    assert got["q"].ndcg == pytest.approx((3 + 7 / 1.584962500721156) / (7 + 3 / 1.584962500721156)) and got["none"].ndcg == 0 and not got["none"].first
    cases = spark.createDataFrame([("x", "old"), ("y", "old"), ("y", "old")], "k string, v string")
    new, faults = judging.overlaid(cases, spark.createDataFrame([("x", "new"), ("y", "new"), ("z", "new")], "k string, v string"), "k", "v")
    assert sorted(r.v for r in new.collect()) == ["new", "old", "old"] and {tuple(r) for r in faults.collect()} == {("y", 2, 1), ("z", 0, 1)}


def test_distances_of_a_batch():
    asked = ["put me through", "put it through", "", "colour in", "take off"]
    stored = ["put sb through", "put sb through", "x", "colo(u)r (sth) in", "take sth off/away"]
    assert phrases.distances(asked, stored).tolist() == [0, 1, 64, 2, 1]


def test_versions_survive_a_batch_that_comes_again(spark, tmp_path):
    t = lambda h: dt.datetime(2025, 1, 1, h)
    batch = lambda *rows: spark.createDataFrame(rows, "k string, at timestamp, n int")
    put = lambda b, i: visits.upsert(b, i, str(tmp_path / "t"), ["k"], [F.col("at")])
    put(batch(("a", t(1), 1), ("b", t(1), 1)), 0)
    put(batch(("a", t(2), 2)), 1)
    put(batch(("a", t(2), 2)), 1)
    put(batch(("c", t(3), 3), ("b", t(0), 9)), 2)
    assert {tuple(r)[0::2] for r in visits.current(spark, str(tmp_path / "t")).collect()} == {("a", 2), ("b", 1), ("c", 3)}
    assert visits.versions(spark, str(tmp_path / "t")) == [1, 2]
