"""Same or nearly same short texts across two sides: exact prefix-filter join on rare shingles.

Two texts match if they are built of the same words in any order, but for a loss: Rule.loss words exchanged or left out,
or the share 1 - Rule.overlap of the longer text's words where that is more. Prefixes, length and position filter follow from the rule.

Alphabetic texts: the shingles are the words. Ordered by rarity over
both sides, the first loss + SIZE words of both texts then have SIZE in common, so every match
shares a combination of SIZE words of these prefixes. The combinations of the evaluation side are indexed,
those of the training side probe them, and the length and the position filter cut down what meets.

Chinese texts: without spaces a word is any block of up to WORD characters (the share 1 - overlap of the text where that is more), and prefixes of character
shingles select too little (see README). The rare shingles here are the cores, the text without one
such block as a bag of characters: two texts match exactly if they have a core in common.

What meets is verified on the words or characters themselves. Texts too short for one exchanged word to
be a small part (fewer than SHORT_WORDS words or SHORT_UNITS characters) match only as equal bags.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.textforms import canonical
from glossa.session import stored

WORD = 5
SHORT_WORDS, SHORT_UNITS = 4, 12
SIZE = 3
#: Word counts are kept in this many cells, a bound for what is broadcast.
CELLS = 1 << 18


@dataclass(frozen=True)
class Rule:
    """What counts as a match: words that may be exchanged or left out, and the share of words that must be common in long texts.

    before, after: set phrases that don't count at the beginning and at the end of a text; none by default.
    """

    loss: int = 1
    overlap: float = 1.0
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()

    def __post_init__(self):
        if not (self.loss >= 0 and 0.75 <= self.overlap <= 1):
            raise ValueError("loss must not be negative, overlap between 0.75 and 1")

    def lost(self, n: int) -> int:
        """Words that two texts, the longer of n words, may differ by."""
        return max(self.loss, int((1 - self.overlap) * n + 1e-9))

    def most(self, n: int) -> int:
        """Bound of lost() for a text of n words, whatever the length of its partner."""
        return max(self.loss, int((1 / self.overlap - 1) * n + 1e-9))

    def short(self) -> int:
        return max(SHORT_WORDS, SIZE + self.loss)

    def block(self, n: int) -> int:
        """Longest block of a text of n characters that may be exchanged."""
        return max(WORD * min(self.loss, 1), int((1 - self.overlap) * n + 1e-9))


_UNIT = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]|[^\W_㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’‘ʼ`´](?=\w)")


def _han(unit: str) -> bool:
    return len(unit) == 1 and ("㐀" <= unit <= "䶿" or "一" <= unit <= "鿿" or "豈" <= unit <= "﫿" or unit >= "\U00020000")


def units(text: str) -> list[str]:
    """Words and single Chinese characters of a text in its consistent form."""
    return _UNIT.findall(_APOSTROPHE.sub("", canonical(text)))


@lru_cache(64)
def _phrases(phrases: tuple[str, ...]) -> list[tuple[str, ...]]:
    return sorted((tuple(units(f)) for f in phrases), key=len, reverse=True)


def unframed(found: list[str], rule: Rule) -> list[str]:
    """Units without the rule's set phrases around them."""
    before, after = _phrases(rule.before), _phrases(rule.after)
    while True:
        start = next((len(f) for f in before if len(found) > len(f) and tuple(found[: len(f)]) == f), 0)
        end = next((len(f) for f in after if len(found) - start > len(f) and tuple(found[-len(f) :]) == f), 0)
        if not start and not end:
            return found
        found = found[start : len(found) - end]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


_unit_hash = lru_cache(1 << 16)(_hash)


def kind_of(found: list[str]) -> str:
    return "units" if 2 * sum(map(_han, found)) >= len(found) else "words"


def shingles(found: list[str]) -> list[int]:
    """Hashes of a text's words; the k-th occurrence of a word is a shingle of its own."""
    seen: Counter[str] = Counter()
    out = []
    for p in found:
        seen[p] += 1
        out.append(_unit_hash(f"{p}\t{seen[p]}"))
    return out


def keys(found: list[str], counts: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, shingles or units it stands for, shingles after its last) of a text; the first key is that of the whole bag."""
    kind = kind_of(found)
    one = np.array([_unit_hash(u) for u in found], dtype=np.int64)
    n = len(found)
    if kind == "units":
        sums = np.concatenate([[0], np.cumsum(one)])  # wraps around, as any sum of hashes here
        bags, sizes = [sums[-1:]], [np.array([n])]
        if n >= SHORT_UNITS:
            for block in range(1, min(rule.block(n), n - 1) + 1):
                bags.append(sums[-1] - (sums[block:] - sums[:-block]))
                sizes.append(np.full(n - block + 1, n - block))
        key, size = np.concatenate(bags), np.concatenate(sizes)
        key, first = np.unique(key, return_index=True)
        return key, size[first], np.full(key.size, 1 << 30)
    out = [(int(one.sum()), n, 1 << 30)]
    if n >= rule.short():
        ordered = sorted(shingles(found), key=lambda h: (counts[h & (CELLS - 1)], h))
        for chosen in combinations(range(min(n, rule.most(n) + SIZE)), SIZE):
            out.append((_hash("words" + ",".join(str(ordered[i]) for i in chosen)), n, n - 1 - chosen[-1]))
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out))


def _besides(text: list[str], bag: Counter[str], most: int) -> set[tuple[str, ...]]:
    """What blocks of up to `most` units hold besides bag, for each contiguous block of text that holds it."""
    out: set[tuple[str, ...]] = set()
    for size in range(bag.total(), most + 1):
        for i in range(len(text) - size + 1):
            block = Counter(text[i : i + size])
            if bag <= block:
                out.add(tuple(sorted((block - bag).elements())))
    return out


def match(a: list[str], b: list[str], rule: Rule) -> bool:
    """The exact rule: same words in any order but for the loss."""
    kind = kind_of(a)
    if kind != kind_of(b):
        return False
    only_a, only_b = Counter(a), Counter(b)
    only_a.subtract(only_b)
    only_b = Counter({u: -k for u, k in only_a.items() if k < 0})
    only_a = Counter({u: k for u, k in only_a.items() if k > 0})
    na, nb = only_a.total(), only_b.total()
    if not na and not nb:
        return True
    if kind == "words":
        return max(na, nb) <= rule.lost(max(len(a), len(b))) and min(len(a), len(b)) >= rule.short()
    in_a, in_b = rule.block(len(a)), rule.block(len(b))
    return na <= in_a and nb <= in_b and min(len(a), len(b)) >= SHORT_UNITS and not _besides(a, only_a, in_a).isdisjoint(_besides(b, only_b, in_b))


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(CELLS, dtype=np.int64)
    for pdf in batches:
        for words in map(str.split, pdf["words"]):
            if kind_of(words) == "words":
                np.add.at(total, np.array(shingles(words), dtype=np.int64) & (CELLS - 1), 1)
    there = np.flatnonzero(total)
    yield pd.DataFrame({"cell": there, "n": total[there]})


def cross_classes(df: DataFrame, key: str, side, text: str, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """(we, wt) of the text classes that match across the sides, and (side, words, id): the rows of each class.

    A class is all rows of a side with one text in its consistent form, without set phrases; `words` names it. A link between two
    classes stands for those of all their rows. For side and the defined results see cross_pairs().
    """
    spark = df.sparkSession
    rows = df.select(side.alias("side"), F.col(key).alias("id"), F.col(text).alias("text")).filter("side in ('eval', 'train') and id is not null and text is not null").distinct()
    id_type = rows.schema["id"].dataType.simpleString()

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [unframed(units(q), rule) for q in pdf["text"]]
            yield pd.DataFrame({"side": pdf["side"], "id": pdf["id"], "words": [" ".join(f) for f in found]})[[bool(f) for f in found]]

    members = stored(rows.mapInPandas(prepared, f"side string, id {id_type}, words string"), "overlap-members")
    texts = stored(members.select("side", "words").distinct(), "overlap-texts")

    counted = texts.select("words").mapInPandas(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[counted["cell"]] = counted["n"]
    shared = spark.sparkContext.broadcast(counts)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                made = [keys(w.split(" "), shared.value, rule) for w in part["words"]]
                row = np.repeat(np.arange(len(part)), [k.size for k, _, _ in made])
                text = np.array([_hash(w) for w in part["words"]], dtype=np.int64)
                key, n, after = (np.concatenate(x) for x in zip(*made))
                yield pd.DataFrame({"text": text[row], "key": key, "n": n.astype(np.int32), "after": after.astype(np.int32)})

    # each side's keys are made from its own texts, and neither is broadcast: their number isn't bounded by the size of the texts that Spark sees
    ev, tr = (texts.filter(F.col("side") == s).select("words").mapInPandas(keyed, "text long, key long, n int, after int") for s in ("eval", "train"))
    ev = ev.select("key", F.col("text").alias("te"), F.col("n").alias("ne"), F.col("after").alias("ae"))
    tr = tr.select("key", F.col("text").alias("tt"), F.col("n").alias("nt"), F.col("after").alias("at"))
    # length filter, then position filter: what the key holds and what follows it on the shorter side must reach the overlap
    longer = F.greatest("ne", "nt")
    lost = F.greatest(F.lit(rule.loss), F.floor(F.lit(1 - rule.overlap) * longer + 1e-9))
    near = (F.abs(F.col("ne") - F.col("nt")) <= lost) & (F.least("ae", "at") + SIZE >= longer - lost)
    candidates = ev.join(tr.hint("merge"), "key").filter(near).select("te", "tt").distinct()

    word = texts.select("side", "words", _hash_udf("words").alias("text"))
    we = word.filter("side = 'eval'").select(F.col("text").alias("te"), F.col("words").alias("we"))
    wt = word.filter("side = 'train'").select(F.col("text").alias("tt"), F.col("words").alias("wt"))

    @F.pandas_udf(T.BooleanType())
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([match(x.split(" "), y.split(" "), rule) for x, y in zip(a, b)])

    return candidates.join(we, "te").join(wt, "tt").filter(matched("we", "wt")).select("we", "wt"), members


def cross_pairs(df: DataFrame, key: str, side, text: str, rule: Rule = Rule()) -> DataFrame:
    """(eval_key, train_key) of all rows whose texts match across the sides.

    side: column that is 'eval' or 'train', else the row takes no part. Rows with null key, side or
    text, and texts without any word, have no pairs. Repeated rows give a pair once; texts that differ
    in form only are compared once, whatever the number of their copies, and a pair is written for
    each two keys that hold them: cross_classes() gives the same without writing out copies. Other columns are ignored; an empty side gives no pairs.
    """
    verified, members = cross_classes(df, key, side, text, rule)
    me = members.filter("side = 'eval'").select(F.col("words").alias("we"), F.col("id").alias("eval_key"))
    mt = members.filter("side = 'train'").select(F.col("words").alias("wt"), F.col("id").alias("train_key"))
    return verified.join(me, "we").join(mt, "wt").select("eval_key", "train_key").distinct()


@F.pandas_udf(T.LongType())
def _hash_udf(words: pd.Series) -> pd.Series:
    return words.map(_hash)
