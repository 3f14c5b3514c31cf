from pyspark.sql import functions as F

from glossa.llm.forms_queries import canonical_values, disguised_values
from glossa.llm.textforms import canonical, canonical_column, disguised

PLAIN = ["plain words", "fröh lâg", "源自外来词 жулдать，指（疲倦）；“好”……", "ψάντα", "カシラボ", "κατά", "", "a\nb", "ÅÉ", "ﾟ".replace("ﾟ", "x")]
HIDDEN = {
    "ｓｔｅｔｅ‌ａｒｅｔ\xa0": "stetearet", "clegоrful": "clegorful", "ⅼeеtіrnet": "leetirnet", "babab υр": "babab up", "ﬆingeaskish": "stingeaskish", "êa": "êa",
    "κӧυtіⅽκеt": "köuticket", "织エ": "织工", "⾃⻔不": "自门不", "流‌浪": "流浪", "a　b": "a b", "lâg\xadax": "lâgax",
}


def test_rules():
    assert [x for x in PLAIN if disguised(x)] == []
    for masked, plain in HIDDEN.items():
        assert disguised(masked) and canonical(masked) == canonical(plain) == plain, masked
        assert canonical(canonical(masked)) == canonical(masked)


def test_column_equals_rule(spark):
    values = [*PLAIN, *HIDDEN, None, "  Two  SPACES ", "（Ａ）：；？！，", "ß STRASSE", "İ", "…", "x" * 300_000 + "ｘ"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    found = {r.i: r.c for r in rows.select("i", canonical_column(F.col("v")).alias("c")).collect()}
    assert found == {i: None if v is None else canonical(v) for i, v in enumerate(values)}


def test_found_rows(spark):
    schema = "id long, headword string, chinese_text string, value string, field string"
    rows = [(1, "clegоrful", "plain", "v", "f"), (1, "clegоrful", "plain", "other", "f"), (2, None, "流‌浪", "v", None), (3, "", "", None, None), (4, "ok", "ok", "v", "f")]
    df = spark.createDataFrame(rows, schema)
    found = {tuple(r) for r in disguised_values(df, "t", "id", ("headword", "chinese_text")).collect()}
    assert found == {("t", "1", "headword"), ("t", "2", "chinese_text")}
    assert disguised_values(df.limit(0), "t", "id", ("headword",)).count() == 0
    forms = canonical_values(df, "t", "id", ("headword", "chinese_text"))
    assert forms.count() == 7 and forms.filter("row_key = '2'").first().form == "流浪"


def test_ignorable_and_drawn_format_characters():
    assert canonical("ab\u061ccd") == "abcd" and disguised("ab\u061ccd")
    assert canonical("\u0600١٢") == "\u0600١٢" and not disguised("\u0600١٢")
    assert not any(map(disguised, ["x²", "①", "İstanbul", "straße", "ΐ", "a\r\n b", "ｘ"[:0]])) and all(map(disguised, ["e\u0301", "Ａ", "a\u3000b", "ﬁ"]))
