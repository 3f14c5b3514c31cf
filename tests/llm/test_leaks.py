import random

from glossa.llm.leaks import Index, leaked, leaks

EN = [f"{a} {b} {c} {d}." for a, b, c, d in zip(["Formerly the weary", "Perhaps a dim", "No timid", "Strictly the odd", "In short a frail", "Once a bulky"], ["usher carried a lantern", "porter mended the fence", "cobbler sold every quilt", "orphan admired a bell", "tailor painted the shelf", "miner dropped an oar"], ["towards the lighthouse", "behind the museum", "along the riverbank", "across the boulevard", "beside the chapel", "under the arcade"], ["until dawn came", "before the storm broke", "while nobody watched", "because it rained", "although supper waited", "as the market closed"])]
ZH = "旧时，胆小的晶体不如粒子，于是陶工形容被观测的酶。催化剂已温顺地蒸馏过，所以织工指分子里的基因。波长和真空都要电离，而磁铁靠细胞测量。"
FILL = "Nothing of note happened in that village during the long winter, and people stayed indoors. "


def _pairs(items, texts):
    d, i, _ = leaked(Index(items), texts)
    return set(zip(d.tolist(), i.tolist()))


def test_kinds_of_leaks():
    items = [" ".join(EN), ZH]
    whole = " ".join(EN)
    texts = [
        FILL + whole + FILL,
        FILL + whole[: len(whole) * 2 // 5] + FILL,
        FILL * 3 + EN[4] + FILL + EN[1] + FILL + EN[2],
        FILL + "<p>" + whole.upper().replace(" ", "\n| ") + "</p>",
        FILL + whole.replace("lantern", "kettle").replace("museum", "station").replace("quilt", "hammock"),
        FILL + EN[0],
        FILL + ZH[:34],
        FILL + "​".join(ZH),
        FILL + ZH[:9],
        FILL * 40,
        "",
        "…",
    ]
    assert _pairs(items, texts) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (6, 1), (7, 1)}


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, " ".join(EN), "x"), (1, " ".join(EN), "y"), (2, None, "x"), (None, " ".join(EN), "x"), (3, "", "x"), (4, FILL * 30_000 + ZH, "x")], "doc long, text string, i string")
    items = spark.createDataFrame([(10, " ".join(EN)), (10, " ".join(EN)), (11, ZH), (12, None), (13, ""), (14, "?!"), (None, ZH)], "item long, text string")
    found = leaks(docs, "doc", "text", items, "item", "text")
    assert sorted((r.doc, r.item) for r in found.collect()) == [(1, 10), (4, 11)]
    assert leaks(docs.limit(0), "doc", "text", items, "item", "text").count() == 0
    assert leaks(docs, "doc", "text", items.limit(0), "item", "text").count() == 0


def test_batches_agree_with_single_texts():
    r = random.Random(2)
    texts = [FILL * r.randrange(3) + " ".join(r.sample(EN, r.randrange(7))) for _ in range(60)]
    items = [" ".join(EN), " ".join(EN[:3])]
    alone = {(d, i) for d, t in enumerate(texts) for _, i in _pairs(items, [t])}
    assert _pairs(items, texts) == alone and alone


def test_short_sentences_count_together():
    item = "他昨天修好了钟；她在河边种花；我们都忘了带伞；孩子们唱歌去了；老人数着星星；邻居借走梯子。"
    clauses = [c for c in item.replace("。", "；").split("；") if c]
    apart = ZH[:30].join([clauses[4], clauses[1], clauses[3], clauses[0]])
    assert _pairs([item], [FILL + apart + FILL]) == {(0, 0)}
    assert _pairs([item], [FILL + clauses[2] + FILL]) == set()


def test_shared_grams_are_searched_in_parts():
    r = random.Random(4)
    opening = "which of the following sentences about the weary usher is the right one to choose here "
    items = [opening + " ".join(r.choice(EN).lower() for _ in range(2)) + str(i) for i in range(60)]
    texts = [FILL + items[7] + FILL + items[9], opening * 50, FILL, items[3] + opening * 20, ""]
    index = Index(items)
    whole = [x.tolist() for x in leaked(index, texts)]
    for most in (20_000, 60_000):
        parts = [x.tolist() for x in leaked(index, texts, most)]
        assert sorted(zip(*parts)) == sorted(zip(*whole)) and whole[0]
