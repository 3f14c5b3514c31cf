import random

import numpy as np

from glossa.llm.packing import Capacity, best_fit, limits, pack, public_tokenizer, token_counts


def test_every_token_once_and_tight(spark):
    r = random.Random(1)
    sizes = [r.choice([r.randrange(1, 400), r.randrange(1, 1200), 5000]) for _ in range(3000)] + [1024, 1025, 2048]
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)] + [(None, 5, 0), (-1, 0, 0), (-2, None, 0)], "id long, n long, container int")
    rows = pack(df).collect()
    by_doc, by_bin = {}, {}
    for x in rows:
        by_doc.setdefault(x.id, []).append((x.piece, x.first_token, x.tokens))
        by_bin.setdefault(x.container, []).append(x.tokens)
    assert set(by_doc) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        parts = sorted(by_doc[i])
        assert sum(t for *_, t in parts) == n and [f for _, f, _ in parts] == [1024 * k for k in range(len(parts))] and (n > 1024 or len(parts) == 1)
    assert all(sum(ts) <= 1024 and len(ts) <= 256 for ts in by_bin.values())
    assert sum(sizes) / 1024 / len(by_bin) > 0.98
    again = {(x.id, x.piece): x.container for x in pack(df).collect()}
    assert again == {(x.id, x.piece): x.container for x in rows}
    assert pack(df.limit(0)).count() == 0


def test_every_capacity_holds():
    sizes = np.array([500, 400, 300, 200, 100, 50, 50, 50, 900])
    own = best_fit(sizes, Capacity(tokens=1000, documents=2, cost=500_000))
    for b in set(own):
        held = sizes[own == b]
        assert held.sum() <= 1000 and len(held) <= 2 and ((held**2).sum() <= 500_000 or len(held) == 1)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 9), (2, "", 9), (3, None, 9), (None, "x", 9), (4, "字" * 50_000, 9)], "id long, text string, n int")
    found = {r.id: r.n for r in token_counts(df, "id", "text", public_tokenizer()).collect()}
    assert set(found) == {1, 4} and 1 <= found[1] <= 4 and found[4] > 10_000


def test_capacities_that_limit(spark):
    r = random.Random(3)
    cap = Capacity(tokens=1024, documents=4, cost=300_000)
    df = spark.createDataFrame([(i, r.choice([r.randrange(1, 60), r.randrange(200, 540)])) for i in range(2000)], "id long, n long")
    rows = limits(pack(df, cap), cap).collect()
    assert all(x.tokens <= 1024 and x.pieces <= 4 and x.cost <= 300_000 for x in rows)
    assert {x.limit for x in rows} >= {"documents", "cost"} and sum(x.pieces for x in rows) == 2000
