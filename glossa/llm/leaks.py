"""Passages of held-out items inside a large corpus: q-gram lemma filter on diagonal bands, then banded alignment.

The items are a fixed set and are broadcast in blocks of BLOCK_CHARS; the corpus is read once per
block and never shuffled. In each batch of documents:

1. every q-gram (Q_HAN Chinese characters or Q_LETTERS letters) that an item has too gives a hit (document place x, item place y);
2. hits of a document and an item are counted in overlapping bands of the diagonal x - y, and a run of
   hits without a gap of more than GAP makes a region. By the q-gram lemma a region of w characters with k
   exchanged words keeps w - q + 1 - k (q + word - 1) grams; regions below the bound for one
   exchange every SPAN characters are dropped; the others are extended as far as the characters agree, and then those lighter
   than LEAST are dropped unless they hold a whole sentence of the item;
3. a pair whose regions cover SHARE of the item is verified: each region must align within its band at a cost of at most COST of its length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.streams import grams, is_han, sentence_bounds, slices, stream

Q_HAN, Q_LETTERS = 6, 16
#: By script of the item, Han first: longest gap between hits of a region, characters to one exchanged word, and the word's length.
GAP, SPAN, EXCHANGED = (20, 45), (12, 26), (3, 8)
#: Shortest region that holds no whole sentence, where a letter weighs 1 and a Han character HAN.
LEAST, HAN = 40, 3
BAND = 32
SHARE, COST = 0.28, 0.25
BLOCK_CHARS = 20_000_000
WINDOW = 1 << 20
#: Hits that are held at once; documents with more are searched for the items in parts.
HITS = 4_000_000
BITS = 22


class Index:
    """The q-grams of a block of items."""

    def __init__(self, texts: list[str]):
        self.codes, self.starts = stream(texts)
        self.lengths = np.diff(self.starts)
        self.bounds = sentence_bounds(texts)
        mass = np.concatenate([[0], np.cumsum(is_han(self.codes))])
        self.mass = mass
        self.letters = ((HAN + 1) * (mass[self.starts[1:]] - mass[self.starts[:-1]]) < self.lengths).astype(np.int64)
        h = grams(self.codes, Q_HAN, Q_LETTERS)
        item = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(self.codes.size) - self.starts[item]
        q = np.where(is_han(self.codes), Q_HAN, Q_LETTERS)
        whole = (place + q <= self.lengths[item]) & (h != 0)
        order = np.argsort(h[whole], kind="stable")
        self.hash, self.item, self.place = h[whole][order], item[whole][order], place[whole][order]
        self.keys, self.first, self.many = np.unique(self.hash, return_index=True, return_counts=True)
        self.bits = np.zeros(1 << BITS, dtype=bool)
        self.bits[self.keys >> np.uint64(64 - BITS)] = True

    def places(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in codes, key, document, q) of each q-gram that lies within its document and that some item has."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, codes.size, WINDOW):
            h = grams(codes[a : a + WINDOW + Q_LETTERS - 1], Q_HAN, Q_LETTERS)[:WINDOW]
            at = np.flatnonzero(self.bits[h >> np.uint64(64 - BITS)])
            k = np.minimum(np.searchsorted(self.keys, h[at]), self.keys.size - 1)
            same = self.keys[k] == h[at]
            found.append((at[same] + a, k[same]))
        at, k = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        doc = np.searchsorted(starts, at, side="right") - 1
        q = np.where(is_han(codes[at]), Q_HAN, Q_LETTERS)
        inside = at + q <= starts[doc + 1]
        return at[inside], k[inside], doc[inside], q[inside]

    def hits(self, starts: np.ndarray, at: np.ndarray, k: np.ndarray, doc: np.ndarray, q: np.ndarray, part: int = 0, parts: int = 1) -> tuple[np.ndarray, ...]:
        """(document, item, x, y, q) of each q-gram of places() and each place of it in the items of one part; at most HITS are made at a time."""
        out = []
        for piece in np.split(np.arange(at.size), np.searchsorted(np.cumsum(self.many[k]), np.arange(HITS, self.many[k].sum() + 1, HITS))):
            many = self.many[k[piece]]
            spread = np.repeat(piece, many)
            post = self.first[k[spread]] + np.arange(spread.size) - np.repeat(np.cumsum(many) - many, many)
            if parts > 1:
                own = self.item[post] % parts == part
                spread, post = spread[own], post[own]
            out.append((doc[spread], self.item[post], (at - starts[doc])[spread], self.place[post], q[spread]))
        return tuple(np.concatenate(x) for x in zip(*out))


def regions(index: Index, doc, item, x, y, q) -> np.ndarray:
    """Rows (document, item, x0, x1, y0, y1) of the regions that meet the bound, from both sets of bands."""
    out = []
    for shift in (0, BAND // 2):
        band = (x - y + shift) // BAND
        order = np.lexsort((y, band, item, doc))
        d, i, b, yy, xx, qq = doc[order], item[order], band[order], y[order], x[order], q[order]
        if not d.size:
            continue
        gap = np.asarray(GAP)[index.letters[i]]
        new = np.ones(d.size, dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (yy[1:] - yy[:-1] > gap[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], d.size) - 1
        count = last - first + 1
        y0, y1 = yy[first], yy[last] + qq[last]
        x0, x1 = xx[first], xx[last] + qq[last]
        lang = index.letters[i[first]]
        w, gram = y1 - y0, np.array([Q_HAN, Q_LETTERS])[lang]
        lost = (w // np.asarray(SPAN)[lang]) * (gram + np.asarray(EXCHANGED)[lang] - 1)
        keep = count >= np.maximum(1, w - gram + 1 - lost)
        out.append(np.stack([d[first], i[first], x0, x1, y0, y1], axis=1)[keep])
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 6), dtype=np.int64)


def extended(codes: np.ndarray, starts: np.ndarray, index: Index, found: np.ndarray) -> np.ndarray:
    """Regions with their ends moved out while document and item agree, at most a long q-gram's length."""
    d, i, x0, x1, y0, y1 = (c.copy() for c in found.T)
    for step, x, y in ((-1, x0, y0), (1, x1, y1)):
        going = np.arange(len(found))
        for _ in range(Q_LETTERS):
            xx, yy = x[going] + min(step, 0), y[going] + min(step, 0)
            inside = (xx >= 0) & (yy >= 0) & (xx < starts[d[going] + 1] - starts[d[going]]) & (yy < index.lengths[i[going]])
            going, xx, yy = going[inside], xx[inside], yy[inside]
            going = going[codes[starts[d[going]] + xx] == index.codes[index.starts[i[going]] + yy]]
            x[going] += step
            y[going] += step
    return np.stack([d, i, x0, x1, y0, y1], axis=1)


def weighty(index: Index, found: np.ndarray) -> np.ndarray:
    """Whether a region weighs LEAST or holds a whole sentence of its item, however short."""
    start = index.starts[found[:, 1]]
    y0, y1 = start + found[:, 4], start + found[:, 5]
    first, last = np.searchsorted(index.bounds, y0), np.searchsorted(index.bounds, y1, side="right") - 1
    return (y1 - y0 + (HAN - 1) * (index.mass[y1] - index.mass[y0]) >= LEAST) | (last > first)


def covered(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, characters of the item under the union of the pair's regions)."""
    if not len(found):
        return (np.zeros(0, dtype=np.int64),) * 3
    found = found[np.lexsort((found[:, 4], found[:, 1], found[:, 0]))]
    pair = np.ones(len(found), dtype=bool)
    pair[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    number = np.cumsum(pair) - 1
    far = number * (1 << 40)
    reach = np.maximum.accumulate(found[:, 5] + far)
    before = np.concatenate([[0], reach[:-1]])
    new = np.maximum(0, found[:, 5] + far - np.maximum(found[:, 4] + far, before))
    first = np.flatnonzero(pair)
    return found[first, 0], found[first, 1], np.add.reduceat(new, first)


def aligned(codes: np.ndarray, starts: np.ndarray, index: Index, found: np.ndarray) -> np.ndarray:
    """Whether each region's two pieces align within BAND of its diagonal at a cost under COST; a batch of dynamic programs."""
    good = np.zeros(len(found), dtype=bool)
    width = 2 * BAND + 1
    by_length = np.argsort(found[:, 5] - found[:, 4])
    for a in range(0, len(found), 256):
        part = by_length[a : a + 256]
        d, i, x0, x1, y0, y1 = found[part].T
        n, m = y1 - y0, x1 - x0
        long = int(n.max())
        left = starts[d] + x0
        right = index.starts[i] + y0
        offset = np.arange(-BAND, BAND + 1)
        cost = np.where(offset >= 0, offset, 1 << 20)[None, :].repeat(len(part), 0).astype(np.int32)
        final = np.full(len(part), 1 << 20, dtype=np.int32)
        for row in range(1, long + 1):
            col = row + offset  # characters of the document piece used so far
            there = (col[None, :] >= 0) & (col[None, :] <= m[:, None])
            a_at = np.minimum(right + row - 1, index.codes.size - 1)
            b_at = np.clip(left[:, None] + col[None, :] - 1, 0, codes.size - 1)
            differ = (index.codes[a_at][:, None] != codes[b_at]) | (col[None, :] < 1)
            new = cost + differ
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            new = np.where(there, new, 1 << 20)
            steps = np.arange(width)
            cost = (np.minimum.accumulate(new - steps, axis=1) + steps).astype(np.int32)
            cost = np.where(there, cost, 1 << 20)
            done = np.flatnonzero(n == row)
            if done.size:
                place = m[done] - row + BAND
                ok = (place >= 0) & (place < width)
                final[done[ok]] = cost[done[ok], place[ok]]
        good[part] = final <= COST * np.maximum(n, m)
    return good


def _leaked(index: Index, codes: np.ndarray, starts: np.ndarray, hits: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = extended(codes, starts, index, regions(index, *hits))
    found = found[weighty(index, found)]
    d, i, chars = covered(found)
    enough = chars >= SHARE * index.lengths[i]
    pairs = d[enough] * len(index.lengths) + i[enough]
    found = found[np.isin(found[:, 0] * len(index.lengths) + found[:, 1], pairs)]
    if len(found):
        found = found[aligned(codes, starts, index, found)]
    d, i, chars = covered(found)
    share = chars / np.maximum(1, index.lengths[i])
    enough = share >= SHARE
    return d[enough], i[enough], share[enough]


def leaked(index: Index, texts: list[str], most: int = HITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, place of the item, share of the item covered) of every leak in a batch.

    A q-gram that many items share gives many hits; whole documents are taken together up to `most` hits, and one document with
    more is searched for the items in parts, which changes nothing: a region belongs to one document and one item.
    """
    codes, starts = stream(texts)
    at, k, doc, q = index.places(codes, starts)
    if not at.size:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    load = np.add.reduceat(index.many[k], first)
    ends = np.append(first[1:], at.size)
    out, n = [], 0
    while n < first.size:
        last = max(n + 1, int(np.searchsorted(np.cumsum(load[n:]), most, side="right")) + n)
        a, b, parts = first[n], ends[last - 1], int(-(-load[n:last].sum() // most))
        n = last
        for part in range(parts):
            out.append(_leaked(index, codes, starts, index.hits(starts, at[a:b], k[a:b], doc[a:b], q[a:b], part, parts)))
    return tuple(np.concatenate(x) for x in zip(*out))


#: The last index of a worker by the broadcast it was made from: the tasks of a worker share it.
_made: dict[str, Index] = {}


def _index(name: str, texts: list[str]) -> Index:
    if name not in _made:
        _made.clear()
        _made[name] = Index(texts)
    return _made[name]


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key, share): which documents hold which items, and how much of the item.

    Null keys or texts take no part; empty texts and items without letters leak nowhere. A document or
    item given twice gives its pairs once. Texts are read whole, whatever their length. Other columns are ignored.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(doc_key).alias("d"), F.col(doc_text).alias("t")).filter("d is not null and length(t) > 0")
    chosen = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).filter("i is not null and length(t) > 0").distinct()
    size = chosen.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    d_type, i_type = read.schema["d"].dataType.simpleString(), chosen.schema["i"].dataType.simpleString()
    schema = f"d {d_type}, i {i_type}, share double"
    out = spark.createDataFrame([], schema)
    for n in range(blocks):
        block = chosen.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n).toPandas()  # all items in turn, not a subset
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block["i"].to_numpy(), block["t"].tolist()))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            name, ids, texts = shared.value
            index = _index(name, texts)
            for pdf in batches:
                for part in slices(pdf, "t"):
                    d, i, share = leaked(index, part["t"].tolist())
                    yield pd.DataFrame({"d": part["d"].to_numpy()[d], "i": ids[i], "share": share})

        out = out.unionByName(read.mapInPandas(search, schema))
    best = out.groupBy("d", "i").agg(F.max("share").alias("share"))
    return best.select(F.col("d").alias(doc_key), F.col("i").alias(item_key), "share")
