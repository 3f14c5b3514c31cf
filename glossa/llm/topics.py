"""Subject areas of documents: free latent Dirichlet topics over all documents, mapped to subjects by inspected terms.

Terms are words and, in Chinese, pairs of neighbouring characters, hashed to CELLS. The vocabulary is every
term in at least RARE and at most COMMON of the documents whose residual inverse document frequency is at least
CONTENT: words that, once they occur in a text, occur again in it, as function words and scenery don't. Its size is at
most (terms per document) / RARE, whatever the corpus.

The topics are free: no term is tied to any of them. They start from a fit on START documents (a bounded sample) and are then
fitted by variational inference over all documents, in STEPS rounds of which each takes its share; only sums
by term reach the driver. SEEN holds, for each subject, some of the terms that stood at the top of topics fitted in this way and that a
reader gave to the subject; a topic belongs to the subject with most of these terms among its own TOP first ones.

A document's topic proportions are taken over its sentences: the inference, under the document's own mixture, gives
the terms of a sentence to topics, and a sentence counts for the subject to which it gives most of them, at least MASS.
Subjects that reach SHARE of the sentences are the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.streams import _table, is_han, slices
from glossa.llm.textforms import _ignorable
from glossa.session import stored

CELLS = 1 << 20
RARE, COMMON, CONTENT = 0.002, 0.12, 0.2
#: Topics, documents of the sample they start from and rounds over it, rounds over all documents, rounds of a document's inference.
TOPICS, START, START_ROUNDS, STEPS, INNER = 60, 3000, 20, 4, 4
ALPHA, ETA = 0.03, 0.01
#: First terms of a topic that decide its subject, and how many inspected ones there must be.
TOP, NAMED = 20, 2
#: Terms of a sentence that must fall to a subject: more than one, for a single word can be taken from any subject.
MASS = 1.2
#: Share of sentences from which a document has a subject: between a passing mention (a tenth) and a quarter.
SHARE = 0.17

# Inspected top terms of freely fitted topics by the subject that a reader gave the topic.
SEEN = {
    "software": "module debugger firmware kernel packet compiler browser 数据库 编译器 浏览器 固件 模块 内核 线程",
    "science": "electron solvent wavelength titration spectrum catalyst isotope 催化剂 晶体 光谱 电荷 真空 波长 同位素",
    "medicine": "tablet symptom bandage nurse infection vaccine thermometer 感染 症状 剂量 病房 脉搏 诊所 绷带",
    "law": "warrant tribunal witness testimony affidavit verdict jury 原告 证人 逮捕令 保释 判决 律师 法庭",
    "sport": "trophy tournament umpire wicket stadium hurdle goalkeeper 教练 奖杯 跨栏 点球 马拉松 球拍 守门员",
    "finance": "tax dividend creditor portfolio inflation shareholder mortgage 贷款 抵押 投资 审计 赤字 利率 债券",
    "music": "harmony overture melody refrain violin choir soprano 小提琴 长笛 节拍 音阶 奏鸣曲 合唱团 和弦",
    "cooking": "garlic noodle recipe marinade dough yeast casserole 打蛋器 食谱 砂锅 面糊 腌料 煎锅 面团",
    "farming": "pasture poultry tractor cattle fertiliser livestock orchard 灌溉 小麦 牧场 家禽 谷仓 干草 果园",
    "seafaring": "anchor rudder voyage keel hull compass lifeboat 船舵 浮标 龙骨 港口 船锚 罗盘 桅杆",
    "warfare": "infantry garrison armistice platoon trench artillery cavalry 伏击 哨兵 火炮 步兵 要塞 战壕 手榴弹",
    "building": "excavator lintel blueprint architect scaffold girder plumbing 钢梁 隔热层 瓦片 水泥 起重机 椽子 砖块",
}

_END = np.array([ord(c) for c in ".!?。！？\n"], dtype=np.uint32)


@cache
def _kinds() -> np.ndarray:
    """By character: 0 between words, 1 letter, 2 Han, 3 invisible, 4 end of a sentence."""
    kinds = np.zeros(_table().size, dtype=np.uint8)
    kinds[_table() != 0] = 1
    kinds[is_han(_table())] = 2
    kinds[[i for i in range(0x10000) if not 0xD800 <= i < 0xE000 and _ignorable(chr(i))]] = 3
    kinds[_END] = 4
    return kinds


#: Words and pairs of Chinese characters as they are written, overlapping.
_WRITTEN = re.compile(r"(?=([\u3400-\u9fff]{2}))|([^\W\d_\u3400-\u9fff]+)")

_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(44)).astype(np.int64)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence in it, term) of every term of a batch in order, and the number of sentences of each document.

    Sentences without any letter don't count.
    """
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    kind = _kinds()[np.minimum(raw, _kinds().size - 1)]
    shown = np.flatnonzero(kind != 3)
    kind, at = kind[shown], shown
    code = _table()[np.minimum(raw[shown], _table().size - 1)].astype(np.uint64)
    doc = np.searchsorted(ends, at, side="right").astype(np.int64)
    n = kind.size
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(len(texts), np.int64),)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = doc[1:] != doc[:-1]
    sentence = np.cumsum((kind == 4) | fresh)
    letter = kind == 1
    before = np.concatenate([[False], letter[:-1]]) & ~fresh
    first = np.flatnonzero(letter & ~before)
    after = np.ones(n, dtype=bool)
    after[:-1] = ~letter[1:] | fresh[1:]
    last = np.flatnonzero(letter & after)
    size = 1 << max(12, int(n).bit_length())
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(letter, code, 0).astype(np.uint64) * _powers(_B, size)[:n], dtype=np.uint64)])
        words = _mixed((sums[last + 1] - sums[first]) * _powers(_B_INVERSE, size)[first])
        pair = np.flatnonzero((kind[:-1] == 2) & (kind[1:] == 2) & ~fresh[1:])
        pairs = _mixed((code[pair] << np.uint64(21)) + code[pair + 1] + np.uint64(1 << 60))
    places = np.concatenate([first, pair])
    terms = np.concatenate([words, pairs])
    order = np.argsort(places, kind="stable")
    places, terms = places[order], terms[order]
    said = np.flatnonzero(letter | (kind == 2))
    number, start = np.unique(sentence[said], return_index=True)
    count = np.bincount(doc[said[start]], minlength=len(texts))
    first_of = np.concatenate([[0], np.cumsum(count)[:-1]])
    inside = np.searchsorted(number, sentence[places]) - first_of[doc[places]]
    return doc[places], inside, terms, count


def term_ids(text: str) -> np.ndarray:
    return np.unique(tokens([text])[2])


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    docs, times, read = np.zeros(CELLS, dtype=np.int64), np.zeros(CELLS, dtype=np.int64), 0
    for pdf in batches:
        for part in slices(pdf, "text"):
            doc, _, term, _ = tokens(part["text"].tolist())
            docs += np.bincount(np.unique(doc * CELLS + term) % CELLS, minlength=CELLS)
            times += np.bincount(term, minlength=CELLS)
            read += len(part)
    there = np.flatnonzero(docs)
    yield pd.DataFrame({"cell": np.append(there, -1), "docs": np.append(docs[there], read), "times": np.append(times[there], 0)})


def content_terms(texts: DataFrame) -> np.ndarray:
    """The vocabulary: cells of the terms of a table (text) that are neither rare nor common and that come in bursts."""
    counted = texts.mapInPandas(_counted, "cell long, docs long, times long").groupBy("cell").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    total = counted.filter("cell = -1").select(F.col("docs").alias("all"))
    share = F.col("docs") / F.col("all")
    residual = F.log2(1 - F.exp(-F.col("times") / F.col("all"))) - F.log2(share)
    within = (F.col("docs") >= F.greatest(F.lit(2), F.col("all") * RARE)) & (F.col("docs") <= F.greatest(F.lit(2), F.col("all") * COMMON))
    kept = counted.crossJoin(F.broadcast(total)).filter((F.col("cell") >= 0) & within & (residual >= CONTENT))  # total is one row
    return np.sort(kept.select("cell").toPandas()["cell"].to_numpy(dtype=np.int64))


def proportions(doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, beta: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(topic proportions of each document, topic shares of each entry): the variational step by fixed-point rounds. beta: term x topic."""
    k = beta.shape[1]
    theta = np.full((n, k), 1 / k, dtype=np.float32)
    likely = beta[term]
    share = likely
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    for _ in range(inner):
        share = likely * theta[doc]
        share *= (count / np.maximum(share.sum(axis=1), 1e-30)).astype(np.float32)[:, None]
        theta = np.full((n, k), ALPHA, dtype=np.float32)
        if start.size:
            theta[doc[start]] += np.add.reduceat(share, start)
        theta /= theta.sum(axis=1, keepdims=True)
    return theta, share


def _sums(doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, beta: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary entries, their terms by topic) of a batch."""
    _, share = proportions(doc, term, count, n, beta, inner)
    order = np.argsort(term, kind="stable")
    first = np.flatnonzero(np.diff(term[order], prepend=-1))
    return term[order][first], np.add.reduceat(share[order], first) if first.size else share[:0]


def _likely(weight: np.ndarray) -> np.ndarray:
    """term x topic probabilities of topics with these term weights."""
    beta = weight + ETA
    return (beta / beta.sum(axis=0)).astype(np.float32)


def _entries(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sentence, vocabulary entry) of a batch of stored documents."""
    both = [np.frombuffer(x, dtype=np.int32).reshape(2, -1) for x in pdf["terms"]]
    row = np.repeat(np.arange(len(both)), [b.shape[1] for b in both])
    sentence, term = np.concatenate(both, axis=1).astype(np.int64) if both else np.zeros((2, 0), np.int64)
    return row, sentence, term


def _grouped(row: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, count = np.unique(row * width + term, return_counts=True)
    return pair // width, pair % width, count


def _start(small: DataFrame, width: int) -> np.ndarray:
    """Term weights of free topics fitted on the START documents with the smallest hash of their terms; a document adds at most `width` entries."""

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, _, term = _entries(pdf)
            doc, entry, count = _grouped(row, term, width)
            packed, at = np.stack([entry, count]).astype(np.int32), np.searchsorted(doc, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"bag": [packed[:, a:b].tobytes() for a, b in zip(at, at[1:])]})

    chosen = small.filter("length(terms) > 0").select("terms").orderBy(F.xxhash64("terms"), "terms").limit(START)
    both = [np.frombuffer(b, dtype=np.int32).reshape(2, -1) for b in chosen.mapInPandas(bags, "bag binary").toPandas()["bag"]]
    rng = np.random.default_rng(3)
    weight = rng.gamma(1, 1, (width, TOPICS))
    if not both:
        return weight
    doc = np.repeat(np.arange(len(both)), [b.shape[1] for b in both])
    term, count = np.concatenate(both, axis=1).astype(np.int64)
    for _ in range(START_ROUNDS):
        entry, sums = _sums(doc, term, count, len(both), _likely(weight), 2)
        weight = np.zeros((width, TOPICS))
        weight[entry] = sums
    return weight


def topics_of(small: DataFrame, width: int) -> np.ndarray:
    """term x topic probabilities of the topics of stored documents (sentences, terms, round)."""
    spark = small.sparkSession
    weight = _start(small, width)
    for step in range(STEPS):
        beta = spark.sparkContext.broadcast(_likely(weight))

        def gather(batches: Iterator[pd.DataFrame], beta=beta) -> Iterator[pd.DataFrame]:
            stats = np.zeros((width, TOPICS))
            for pdf in batches:
                for a in range(0, len(pdf), 500):
                    row, _, term = _entries(part := pdf.iloc[a : a + 500])
                    entry, sums = _sums(*_grouped(row, term, width), len(part), beta.value)
                    stats[entry] += sums
            there = np.flatnonzero(stats)
            yield pd.DataFrame({"cell": there, "n": stats.ravel()[there]})

        sums = small.filter(F.col("round") == step).select("terms").mapInPandas(gather, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        new = np.zeros((width, TOPICS))
        np.put(new, sums["cell"].to_numpy(), STEPS * sums["n"].to_numpy())
        # the start is a sample: it weighs as much as a round, on the same scale
        weight = weight * (new.sum() / max(weight.sum(), 1e-30)) if step == 0 else weight
        rate = 1 / (step + 2)
        weight = (1 - rate) * weight + rate * new if new.any() else weight
    return _likely(weight)


def owners(beta: np.ndarray, vocabulary: np.ndarray, seen: dict[str, str] = SEEN) -> np.ndarray:
    """Place of each topic's subject in `seen`, -1 for none: most inspected terms among its first TOP, at least NAMED and more than all others together."""
    known = np.stack([np.isin(vocabulary, term_ids(terms.replace(" ", "\n"))) for terms in seen.values()])
    first = np.argsort(-beta, axis=0, kind="stable")[:TOP]
    found = known[:, first].sum(axis=1)
    best = found.argmax(axis=0)
    most = found.max(axis=0)
    return np.where((most >= NAMED) & (2 * most > found.sum(axis=0)), best, -1)


def _compacted(read: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(id, sentences, terms, round): each document's vocabulary entries with their sentences, packed, in shared storage."""
    known = read.sparkSession.sparkContext.broadcast(vocabulary)

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(CELLS, -1, dtype=np.int32)
        place[known.value] = np.arange(len(known.value))
        for pdf in batches:
            for part in slices(pdf, "text"):
                doc, sentence, term, count = tokens(part["text"].tolist())
                entry = place[term]
                there = entry >= 0
                doc, packed = doc[there], np.stack([sentence[there].astype(np.int32), entry[there]])
                at = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "sentences": count.astype(np.int32), "terms": [packed[:, a:b].tobytes() for a, b in zip(at, at[1:])]})

    schema = f"id {read.schema['id'].dataType.simpleString()}, sentences int, terms binary"
    return stored(read.mapInPandas(compact, schema).withColumn("round", F.pmod(F.xxhash64("id"), F.lit(STEPS))), "topic-terms")


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and length(text) > 0")


def subjects_of(docs: DataFrame, key: str, text: str, seen: dict[str, str] = SEEN) -> DataFrame:
    """(key, subject, share) of every document and subject that at least SHARE of its sentences deal with.

    Null keys and texts take no part, empty texts and texts without letters have no subject. A key that comes twice
    counts each of its texts in the fit and gives its subjects once, with the greatest share.
    Other columns are ignored; an empty corpus, and one without any content term, gives no rows.
    """
    spark = docs.sparkSession
    read = _read(docs, key, text)
    schema = f"id {read.schema['id'].dataType.simpleString()}, subject string, share double"
    out = lambda df: df.select(F.col("id").alias(key), "subject", "share")
    vocabulary = content_terms(read.select("text"))
    if not vocabulary.size:
        return out(spark.createDataFrame([], schema))
    small = _compacted(read, vocabulary)
    beta = topics_of(small, len(vocabulary))
    names, owner = list(seen), owners(beta, vocabulary, seen)
    shared = spark.sparkContext.broadcast((beta, (owner[:, None] == np.arange(len(names))).astype(np.float32)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beta, belongs = shared.value
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                row, sentence, term = _entries(part)
                theta, _ = proportions(*_grouped(row, term, len(beta)), len(part), beta)
                given = beta[term] * theta[row]
                given /= np.maximum(given.sum(axis=1, keepdims=True), 1e-30)
                spot = row * (1 << 32) + sentence
                first = np.flatnonzero(np.diff(spot, prepend=-1))
                if not first.size:
                    continue
                by_sentence = np.add.reduceat(given @ belongs, first)
                best, deals = by_sentence.argmax(axis=1), by_sentence.max(axis=1) >= MASS
                hits = np.zeros((len(part), len(names)))
                np.add.at(hits, (row[first][deals], best[deals]), 1)
                share = hits / np.maximum(1, part["sentences"].to_numpy())[:, None]
                d, k = np.nonzero(share >= SHARE)
                yield pd.DataFrame({"id": part["id"].to_numpy()[d], "subject": np.array(names, dtype=object)[k], "share": share[d, k]})

    found = small.select("id", "sentences", "terms").mapInPandas(judge, schema)
    return out(found.groupBy("id", "subject").agg(F.max("share").alias("share")))


def topic_report(docs: DataFrame, key: str, text: str, seen: dict[str, str] = SEEN) -> DataFrame:
    """(topic, subject, place, term, weight): the TOP first terms of each fitted topic in writing and the subject it was given, to inspect them.

    A term stands for its hash; of several with one hash the first in order is shown. Defined for the same inputs as subjects_of().
    """
    spark = docs.sparkSession
    read = _read(docs, key, text)
    vocabulary = content_terms(read.select("text"))
    if not vocabulary.size:
        return spark.createDataFrame([], "topic int, subject string, place int, term string, weight double")
    beta = topics_of(_compacted(read, vocabulary), len(vocabulary))
    names, owner = list(seen), owners(beta, vocabulary, seen)
    first = np.argsort(-beta, axis=0, kind="stable")[:TOP]
    tops = [(k, names[owner[k]] if owner[k] >= 0 else None, p + 1, int(vocabulary[i]), float(beta[i, k])) for k in range(TOPICS) for p, i in enumerate(first[:, k])]
    wanted = spark.sparkContext.broadcast(frozenset(t[3] for t in tops))

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: dict[str, int] = {}
        for pdf in batches:
            for word in {a or b for t in pdf["text"] for a, b in _WRITTEN.findall(t.lower())}:
                if word not in cells:
                    ids = term_ids(word)
                    cells[word] = int(ids[0]) if len(ids) == 1 else -1
        rows = [(w, c) for w, c in cells.items() if c in wanted.value]
        yield pd.DataFrame(rows, columns=["term", "cell"])

    terms = read.select("text").mapInPandas(written, "term string, cell long").groupBy("cell").agg(F.min("term").alias("term"))
    table = spark.createDataFrame(tops, "topic int, subject string, place int, cell long, weight double")
    return table.join(terms, "cell", "left").select("topic", "subject", "place", "term", "weight")
