import numpy as np

from glossa.llm import neighbours as nb


def _frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, bytes(v.astype(np.int8).tobytes()), "e") for i, v in enumerate(x)], "id long, v binary, rep string")


def _brute(x, k, least):
    norm = np.linalg.norm(x.astype(float), axis=1)
    unit = x.astype(float) / np.maximum(norm, 1e-9)[:, None]
    cosine = (unit @ unit.T).round(12)
    out = {}
    for i in np.flatnonzero(norm):
        near = sorted((-cosine[i, j], int(j)) for j in np.flatnonzero(norm) if j != i)[:k]
        out[int(i)] = [(j, round(-s, 9)) for s, j in near if -s >= least]
    return out


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(2)
    heads = r.normal(size=(300, 32))
    x = np.clip(np.concatenate([heads, heads + r.normal(scale=0.25, size=heads.shape), heads + r.normal(scale=0.25, size=heads.shape)]) * 30, -127, 127).round().astype(np.int8)
    found = {(a.id, a.neighbour) for a in nb.neighbours(_frame(spark, x), 5, least=0.9, list_rows=20).collect()}
    want = {(i, j) for i, js in _brute(x, 5, 0.9).items() for j, _ in js}
    assert found <= want and len(found & want) >= 0.95 * len(want)
    some = nb.neighbours(_frame(spark, x), 5, queries="id % 50 = 0", visits=(64, 3.0), list_rows=20).collect()
    want = {(i, j) for i, js in _brute(x, 5, -1).items() if i % 50 == 0 for j, _ in js}
    assert len({(a.id, a.neighbour) for a in some} & want) >= 0.9 * len(want)


def test_copies_zeros_and_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 7)  # every list becomes a grid of blocks
    r = np.random.default_rng(4)
    x = np.concatenate([np.tile(r.integers(-90, 90, (1, 8)), (40, 1)), r.integers(-90, 90, (60, 8)), np.zeros((3, 8))]).astype(np.int8)
    df = _frame(spark, x).union(_frame(spark, x[:5])).union(spark.createDataFrame([(None, b"12345678", "e"), (999, None, "e")], "id long, v binary, rep string"))
    found = {}
    for a in nb.neighbours(df, 5, copies=(64, 9.0), visits=(64, 9.0), list_rows=10).collect():
        found.setdefault(a.id, {})[a.neighbour] = round(a.cosine, 9)
    want = _brute(x, 5, -1)
    assert set(found) == set(want)
    for i, js in want.items():
        assert sorted(found[i].values()) == sorted(s for _, s in js), i
    assert set(found[39]) == {0, 1, 2, 3, 4} and set(found[0]) == {1, 2, 3, 4, 5}
    assert nb.neighbours(df.limit(0), 5).count() == 0


def test_graph_finds_near_centroids():
    r = np.random.default_rng(5)
    heads = nb.unit(np.repeat(r.normal(size=(200, 16)), 10, axis=0) + r.normal(scale=0.3, size=(2000, 16)))
    graph = nb.Graph(heads)
    x = nb.unit(heads[::7] + r.normal(scale=0.1, size=heads[::7].shape))
    found, s = graph.nearest(x, 6)
    exact = np.argsort(-(x @ heads.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, exact)]) > 0.9 and (np.diff(s, axis=1) <= 1e-6).all()
    assert all(len(set(row)) == len(row) for row in found)


def test_blocks(spark):
    rows = [(10, 2, b"\x01\x02\xff\xfe"), (12, 1, b"\x03\x04"), (13, 2, b"\x00"), (None, 1, b"ab"), (20, 1, None), (30, 0, b"")]
    df = spark.createDataFrame(rows, "f long, n int, d binary")
    assert {(r.id, bytes(r.v)) for r in nb.blocks_to_vectors(df, "f", "n", "d", 2).collect()} == {(10, b"\x01\x02"), (11, b"\xff\xfe"), (12, b"\x03\x04")}


def test_visits_grow_with_the_lists(spark):
    x = np.random.default_rng(8).integers(-90, 90, (2600, 16)).astype(np.int8)
    want = {(i, j) for i, js in _brute(x, 5, -1).items() if i % 50 == 0 for j, _ in js}
    recall = []
    for share in (0.0, 0.5):
        found = nb.neighbours(_frame(spark, x), 5, queries="id % 50 = 0", copies=(1, 1.0), visits=(2, 9.0), list_rows=2, share=share).collect()
        recall.append(len({(a.id, a.neighbour) for a in found} & want) / len(want))
    assert recall[0] < 0.5 and recall[1] > 0.9
    graph = nb.Graph(nb.unit(x))
    found, _ = graph.nearest(nb.unit(x[:9]), 260)
    assert all(set(a) == set(b) for a, b in zip(found, np.argsort(-(nb.unit(x[:9]) @ graph.heads.T), axis=1)[:, :260]))
