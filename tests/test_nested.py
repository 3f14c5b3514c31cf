import json

import pytest

from glossa.operators import nested
from glossa.plans.nested_queries import ARTICLE, p5_found


def test_deep_records_parse_as_shallow_ones():
    for text in ('{"a": [1, -2.5e3, "x\\"y", null, true, {}, []], "b": {"c": [[1], []]}}', "[]", "{}", ' "s" ', "3"):
        assert nested._parse_deep(text) == json.loads(text)
    deep = "[" * 100_000 + "]" * 100_000
    value = nested.parse(deep)
    for _ in range(99_999):
        value = value[0]
    assert value == []
    for bad in ("", "[1,]", '{"a" 1}', "[1", "{,}", "[1] x", '{"a": }', "]", "tru"):
        with pytest.raises(ValueError):
            nested._parse_deep(bad)


def _found(spark, tmp_path, rows):
    path = str(tmp_path / "etymology_articles.parquet")
    spark.createDataFrame(rows, "id string, payload string, extra int, record string").write.mode("overwrite").parquet(path)
    return sorted(map(tuple, p5_found(spark, str(tmp_path)).collect()))


def test_uneven_shapes(spark, tmp_path):
    doc = {"blocks": [{"runs": [{"text": "a", "marks": ["x", "y"]}, None, "plain", {"text": "b", "marks": None}]}, {"runs": {"text": "c", "marks": "z"}}, {"runs": None}, {"kind": "quote"}]}
    want = [(0, 0, 0, "x"), (0, 0, 1, "y"), (0, 2, -1, ""), (0, 3, -1, ""), (1, 0, 0, "z")]
    rows = [
        ("bare", json.dumps(doc), 1, "r"),
        ("wrapped", json.dumps({"label": "l", "article": {"document": doc}, "related": [{"document": {"blocks": [{"runs": "no"}]}}]}), 1, None),
        ("bom", "﻿" + json.dumps(doc), None, None),
        ("quoted", json.dumps(json.dumps(doc)), 1, "r"),
        ("again", json.dumps(doc), 1, "r"),
        ("again", json.dumps(doc), 2, "r"),
        ("cut", json.dumps(doc)[:-5], 1, "r"),
        ("empty", "", 1, "r"),
        ("null", None, 1, "r"),
        ("number", "17", 1, "r"),
        ("none", '{"x": 1}', 1, "r"),
        ("nothing", '{"blocks": null}', 1, "r"),
        (None, json.dumps(doc), 1, "r"),
        ("one", json.dumps({"blocks": {"runs": "s"}}), 1, "r"),
    ]
    expected = sorted([(k, *w) for k in ("bare", "wrapped", "bom", "quoted", "again") for w in want] + [("one", 0, 0, -1, "")])
    assert _found(spark, tmp_path, rows) == expected


def test_empty_table_and_long_text(spark, tmp_path):
    assert _found(spark, tmp_path, []) == []
    long = json.dumps({"blocks": [{"runs": [{"text": "x" * 2_000_000, "marks": ["m"]}] * 3}]})
    assert _found(spark, tmp_path, [("long", long, 1, "r")]) == [("long", 0, i, 0, "m") for i in range(3)]


def test_tables_name_their_parents(spark):
    rows = [("k", '{"blocks": [{"kind": "p", "runs": [{"text": "t", "link": {"targetTerm": "w"}}]}, "s"]}')]
    triples = nested.shred(spark.createDataFrame(rows, "id string, payload string"), "id", "payload", ARTICLE)
    blocks = nested.table(triples, "blocks[]", ["block_no"], {"kind_": "kind"}, own="plain").collect()
    assert sorted((b.block_no, b.kind, b.kind_ or "", b.plain or "") for b in blocks) == [(0, "object", "p", ""), (1, "string", "", "s")]
    runs = nested.table(triples, "blocks[].runs[]", ["block_no", "run_no"], {"text": "text", "term": "link.targetTerm"}).collect()
    assert [(r.record, r.block_no, r.run_no, r.text, r.term) for r in runs] == [("k", 0, 0, "t", "w")]
    assert {(r.path, r.kind) for r in nested.paths_of(triples).collect()} >= {("blocks[]", "object"), ("blocks[].runs[].link.targetTerm", "string")}
