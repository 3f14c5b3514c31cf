import random

from pyspark.sql import functions as F

from glossa.llm.overlap import Rule, cross_classes, cross_pairs, match, unframed, units
from glossa.llm.overlap_queries import RULE

TIME = ["清晨", "午夜过后", "很久以前", "每逢周二"]
ADJ = ["布满灰尘", "古老", "好奇", "沉默", "朴素"]
WHO = ["流浪者", "陶工", "引座员", "外甥女"]
END = ["为了省钱结果成功了", "碍于情面最后放弃了", "一时糊涂差点摔一跤"]


def _made(r, n):
    out = []
    for _ in range(n):
        zh = [r.choice(TIME), r.choice(ADJ) + "的", r.choice(WHO), "在山坡", r.choice(["举起", "盖住"]), r.choice(ADJ) + "的", r.choice(["水桶", "笔记本"]), "，", r.choice(END)]
        en = ["the", r.choice(["old", "dim", "shy", "odd"]), r.choice(["clerk", "twin", "usher"]), "near", "the", r.choice(["mill", "barn"]), r.choice(["moved", "sold"]), "a", r.choice(["bell", "lamp", "oar"])]
        words, joint = (zh, "") if r.random() < 0.5 else (en, " ")
        if r.random() < 0.3:
            del words[r.randrange(len(words))]
        out.append(joint.join(words))
    return out


def test_equals_comparing_all_pairs(spark):
    r = random.Random(3)
    rows = [(f"{side[0]}{i}", side, q, "x", 1) for side, n in (("eval", 60), ("train", 150)) for i, q in enumerate(_made(r, n))]
    rows += [("e-short", "eval", "a b", "", 0), ("t-short", "train", "B, a!", "", 0), ("e-null", "eval", None, "", 0), ("n", None, "a b", "", 0), ("e-empty", "eval", "?!", "", 0), ("t-empty", "train", "", "", 0)]
    rows += [rows[0], rows[70], ("e-long", "eval", "word " * 20_000, "", 0), ("t-long", "train", "word " * 20_001, "", 0)]
    df = spark.createDataFrame(rows, "id string, side string, q string, words string, key int")
    found = {tuple(x) for x in cross_pairs(df, "id", F.col("side"), "q", RULE).collect()}
    found_units = {i: unframed(units(q), RULE) for i, s, q, *_ in rows if s and q}
    want = {(e, t) for e, se, qe, *_ in rows if se == "eval" and found_units.get(e) for t, st, qt, *_ in rows if st == "train" and found_units.get(t) and match(found_units[e], found_units[t], RULE)}
    assert found == want and ("e-short", "t-short") in found and ("e-long", "t-long") in found and len(found) > 20
    assert cross_pairs(df.limit(0), "id", F.col("side"), "q").count() == 0
    assert cross_pairs(df.filter("side = 'eval'"), "id", F.col("side"), "q").count() == 0


def test_rule():
    u = lambda q: unframed(units(q), RULE)
    assert u("How do you say: the OLD ｃlerk") == ["the", "old", "clerk"]
    a = "弯曲的牧羊人晚饭后来到花园，高兴地盖住灵巧的书架，趁着天黑最后放弃了"
    assert match(u(a), u("怎么形容趁着天黑最后放弃了，弯曲的牧羊人晚饭后来到花园高兴地盖住灵巧的书架"), RULE)
    assert match(u(a), u(a.replace("牧羊人", "外甥女") + "的说法"), RULE)
    assert match(u(a), u(a.replace("灵巧的", "")), RULE)
    assert not match(u(a), u(a.replace("牧羊人", "外甥女").replace("书架", "台灯")), RULE)
    assert not match(u("the old clerk sold a bell"), u("the shy clerk sold a lamp"), RULE)


def test_exchanged_words_may_share_a_character():
    u = lambda q: unframed(units(q), RULE)
    a = "弯曲的牧羊人一小时内来到花园高兴地盖住灵巧的书架"
    assert match(u(a), u(a.replace("一小时内", "半小时后")), RULE)
    assert not match(u(a), u(a.replace("一小时内", "半小时后").replace("书架", "台灯")), RULE)


def test_longer_texts_may_lose_more(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base = r.sample(words, r.randrange(4, 30))
        rows.append((f"e{i}", "eval", " ".join(base)))
        for j in range(3):
            other = list(base)
            for _ in range(r.randrange(6)):
                other[r.randrange(len(other))] = r.choice(words)
            r.shuffle(other)
            rows.append((f"t{i}-{j}", "train", " ".join(other[r.randrange(3) :])))
    df = spark.createDataFrame(rows, "id string, side string, q string")
    for rule in (Rule(overlap=0.8), Rule(loss=2), Rule(loss=0)):
        found = {tuple(x) for x in cross_pairs(df, "id", F.col("side"), "q", rule).collect()}
        want = {(e, t) for e, se, a in rows if se == "eval" for t, st, b in rows if st == "train" and match(units(a), units(b), rule)}
        assert found == want and want
    assert Rule(overlap=0.8).lost(20) == 4


def test_classes_stand_for_their_copies(spark):
    rows = [(f"e{i}", "eval", "the old clerk sold a bell") for i in range(50)] + [(f"t{i}", "train", "A bell, the old clerk sold!") for i in range(70)]
    links, members = cross_classes(spark.createDataFrame(rows, "id string, side string, q string"), "id", F.col("side"), "q")
    assert links.count() == 1 and members.count() == 120
