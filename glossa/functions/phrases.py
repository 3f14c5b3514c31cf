"""Stored phrase notation: index terms of a phrase and its distance from a query, slots included."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, product

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa import constants as C

MOST_TERMS, MOST_WORDS, MOST_BYTES = 24, 32, 1024
# A choice of words, and what parts the clauses of a phrase.
CHOICE, CLAUSE = r"\b([A-Za-z]+(?:/[A-Za-z]+)+)\b", r"[|,;]+|\.{3,}|…+"
_CHOICE, _CLAUSE, _GROUP = re.compile(CHOICE), re.compile(CLAUSE), re.compile(r"\([^()]*\)")
_LETTER, _OTHER = re.compile(r"[^\W_]+(?:[-']+[^\W_]+)*"), re.compile(r"[^\x00-\x7f]+")
_PLAIN = str.maketrans("‐‑‒–—−", "------", "ˈˌ")
_HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_ASCII = re.compile(r"[a-z0-9]+(?:[-'][a-z0-9]+)*")


def words(value: str) -> list[str]:
    """ASCII words in lower case, inner hyphens and apostrophes kept, none that touches a letter of another script; Chinese characters part words."""
    text = _HAN.sub(" ", unicodedata.normalize("NFKC", value.translate(_PLAIN)).translate(_PLAIN).lower())
    out = []
    for run in _LETTER.findall(text):
        marked = run if run.isascii() else _OTHER.sub("\0", run)
        beside = lambda m, marked=marked: (marked[: m.start()].rstrip("-'")[-1:], marked[m.end() :].lstrip("-'")[:1])
        out.extend(m[0] for m in _ASCII.finditer(marked) if "\0" not in beside(m))
    return out


def readings(value: str) -> list[str]:
    """The phrase with and without its optional groups, then the clauses of either. A group that isn't closed reaches to the end."""
    bare, before = value, None
    while bare != before:
        before, bare = bare, _GROUP.sub("", bare)
    bare = bare.split("(")[0].replace(")", "")
    return [value, bare, *_CLAUSE.split(value), *_CLAUSE.split(bare)]


def choices(reading: str) -> Iterator[str]:
    """The reading with one word of each choice, in order."""
    parts = _CHOICE.split(reading)  # every second one is a choice
    yield from map("".join, product(*(p.split("/") if i % 2 else [p] for i, p in enumerate(parts))))


@lru_cache(1 << 14)
def _variants(value: str) -> tuple[tuple[str, ...], ...]:
    """Distinct word sequences of a stored phrase: at most MOST_TERMS of each reading."""
    return tuple(dict.fromkeys(tuple(words(c)) for r in readings(value) for c in islice(choices(r), MOST_TERMS)))


def index_terms(value: str) -> list[str]:
    """Terms under which a stored phrase is found: as it is, then each reading with and without slots and light words, which need two words.

    A choice among more words than there is room for gives its first combinations."""
    slots, light = frozenset(C.PLACEHOLDERS), frozenset(C.LIGHT_WORDS)
    forms = [tuple(words(value))]
    for v in _variants(value):
        bare = tuple(w for w in v if w not in slots)
        forms += [f for f in (v, bare, tuple(w for w in bare if w not in light)) if len(f) > 1]
    terms = dict.fromkeys(" ".join(f) for f in forms if f)
    return [t for t in terms if len(t) <= MOST_BYTES][:MOST_TERMS]


def _classes(table: dict[str, int]) -> tuple[np.ndarray, ...]:
    """By word number: person word, thing word, kind of slot (0 none, 1 person, 2 thing, 3 any other)."""
    within = lambda group: np.array([w in group for w in table], dtype=bool)
    slot = np.array([1 if w == "sb" else 2 if w == "sth" else 3 if w in C.PLACEHOLDERS else 0 for w in table], dtype=np.int8)
    return within(C.PERSON_WORDS), within(C.THING_WORDS), slot


def distances(queries: list[str], stored: list[str]) -> np.ndarray:
    """Least edit distance in words from each query to any variant of the phrase beside it.

    Insertions and deletions cost 1, exchanges 2; a slot for a person or thing costs nothing where the query has such a word and 1 otherwise, as any other slot does.
    All pairs of a batch go through one dynamic program over arrays. A query without words has twice MOST_WORDS.
    """
    table: dict[str, int] = {"": 0}
    pair, left, right = [], [], []
    for n, (q, s) in enumerate(zip(queries, stored)):
        asked = words(q)[:MOST_WORDS]
        for v in _variants(s) if asked else ():
            pair.append(n)
            left.append([table.setdefault(w, len(table)) for w in asked])
            right.append([table.setdefault(w, len(table)) for w in v[:MOST_WORDS]])
    best = np.full(len(queries), 2 * MOST_WORDS, dtype=np.int64)
    if not pair:
        return best
    padded = lambda rows: np.array([r + [0] * (max(map(len, rows)) - len(r)) for r in rows], dtype=np.int64).reshape(len(rows), -1)
    a, b = padded(left), padded(right)
    n, m = np.array([len(r) for r in left]), np.array([len(r) for r in right])
    person, thing, slot = _classes(table)
    exchange = np.where(a[:, :, None] == b[:, None, :], 0, np.where(slot[b][:, None, :] > 0, 1, 2))
    filled = ((slot[b] == 1)[:, None, :] & person[a][:, :, None]) | ((slot[b] == 2)[:, None, :] & thing[a][:, :, None])
    exchange[filled] = 0
    row = np.broadcast_to(np.arange(b.shape[1] + 1), (len(pair), b.shape[1] + 1)).copy()
    last = row.copy()
    steps = np.arange(b.shape[1] + 1)
    for i in range(a.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + exchange[:, i, :])
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # insertions along the row
        last[n == i + 1] = row[n == i + 1]
    np.minimum.at(best, np.array(pair), last[np.arange(len(pair)), m])
    return best


def distance(query: str, stored: str) -> int:
    return int(distances([query], [stored])[0])


@F.pandas_udf(T.ArrayType(T.StringType()))
def phrase_index_terms(values: pd.Series) -> pd.Series:
    """index_terms() as a column; null stays null."""
    return values.map(index_terms, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def phrase_distance(queries: pd.Series, stored: pd.Series) -> pd.Series:
    """distances() as a column; null where either is null."""
    there = (queries.notna() & stored.notna()).to_numpy()
    out = pd.array([None] * len(queries), dtype="Int32")
    out[there] = distances(queries[there].tolist(), stored[there].tolist())
    return pd.Series(out)
