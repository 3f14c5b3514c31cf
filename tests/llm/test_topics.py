import random

import numpy as np

from glossa.llm import topics
from glossa.llm.topics import SEEN, owners, subjects_of, term_ids, tokens


def test_tokens():
    doc, sentence, term, count = tokens(["The cat sat. A cat!", "", "…", "猫和狗。猫​和", "x"])
    assert count.tolist() == [2, 0, 0, 2, 1]
    assert doc.tolist() == [0] * 5 + [3] * 3 + [4] and sentence.tolist() == [0, 0, 0, 1, 1, 0, 0, 1, 0]
    assert term[1] == term[4] and term[5] == term[7] and term[5] != term[6]
    assert set(term_ids("CAT")) == {int(term[1])}
    assert np.array_equal(tokens(["a b", "c"])[2], np.concatenate([tokens(["a b"])[2], tokens(["c"])[2]]))


def _corpus(seed, n):
    r = random.Random(seed)
    plain = "candle bucket fence river window basket pillow garden ladder mirror kettle puzzle".split()
    rows = []
    for i in range(n):
        chosen = r.sample(list(SEEN), r.choice([0, 1, 1, 2]))
        parts = []
        for s in chosen:
            terms = SEEN[s].split()
            parts += [f"the {r.choice(terms)} and {r.choice(terms)} met a {r.choice(plain)}." for _ in range(5)]
        parts += [f"a {r.choice(plain)} was {r.choice(plain)} by the {r.choice(plain)}." for _ in range(r.randrange(3, 6))]
        if r.random() < 0.3 and len(parts) > 11:
            parts.append(f"the {r.choice(SEEN['law'].split()[:8])} came.")
        r.shuffle(parts)
        rows.append((i, " ".join(parts), set(chosen)))
    return rows


def test_held_out_accuracy(spark):
    rows = _corpus(1, 600)
    df = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc long, text string, subject string")
    found = {}
    for r in subjects_of(df, "doc", "text").collect():
        found.setdefault(r.doc, set()).add(r.subject)
    right = sum(found.get(i, set()) == want for i, _, want in rows)
    assert right / len(rows) > 0.95


def test_defined_results(spark):
    df = spark.createDataFrame([(1, None), (None, "the cat"), (2, ""), (3, "…"), (4, "database compiler. database server."), (4, "database compiler. database server.")], "doc long, text string")
    assert {r.doc for r in subjects_of(df, "doc", "text").collect()} <= {4}
    assert subjects_of(df.limit(0), "doc", "text").count() == 0


def test_topics_belong_to_the_subject_of_most_inspected_terms():
    seen = {"a": "cat dog cow", "b": "sun moon star"}
    words = "cat dog cow sun moon star x y z".split()
    vocabulary = np.array([int(term_ids(w)[0]) for w in words])
    order = np.argsort(vocabulary)
    beta = np.zeros((len(words), 4))
    for k, first in enumerate(("cat dog x", "sun moon cat", "sun cat y", "x y z")):
        for w in first.split():
            beta[words.index(w), k] = 1
    top, topics.TOP = topics.TOP, 3
    try:
        assert owners(beta[order], vocabulary[order], seen).tolist() == [0, 1, -1, -1]
    finally:
        topics.TOP = top
