"""Texts as one stream of compared characters: vectorised over whole batches.

Letters and digits count, in lower case, without accents, in one form of their look-alikes; all
else (punctuation, spaces, line breaks, invisible characters, markup) is left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd

from glossa.llm.textforms import LATIN_LOOKALIKE, LOOKALIKE, RADICALS

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&#?[A-Za-z0-9]{1,8};")
#: Characters with an expanded form of several letters; they are rare, so the text is rewritten only where one occurs.
_LONG = {c: f for c in map(chr, (*range(0x2160, 0x2180), *range(0xFB00, 0xFB07), 0xDF, 0xE6, 0x153)) if len(f := unicodedata.normalize("NFKC", c).casefold()) > 1}
_LONG_RE = re.compile(f"[{''.join(_LONG)}]")

_ENDING = np.array([ord(c) for c in ".!?;…\n。！？；．"], dtype=np.uint32)


def _compared(c: str) -> int:
    """The code that stands for a character, 0 to leave it out."""
    c = RADICALS.get(c, c)
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", LOOKALIKE.get(c, LATIN_LOOKALIKE.get(c, c))).casefold())
    for x in folded:
        if x.isalnum():
            return ord(LOOKALIKE.get(x, x))
    return 0


@cache
def _table() -> np.ndarray:
    """Code by character; the last entry stands for what lies beyond the first two planes and is kept as it is."""
    codes = np.zeros(0x30000, dtype=np.uint32)
    for i in (*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x10000)):
        codes[i] = _compared(chr(i))
    for a, b in ((0x3400, 0xA000), (0x20000, 0x30000)):
        codes[a:b] = np.arange(a, b)
    for i in range(0x2F800, 0x2FA20):
        codes[i] = _compared(chr(i))
    codes[0x1D400:0x1D800] = [_compared(chr(i)) for i in range(0x1D400, 0x1D800)]
    return codes


def _raw(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts without markup, end of each text in them after a 0, code of each character)."""
    clean = []
    for t in texts:
        if not t.isascii() and _LONG_RE.search(t):
            t = _LONG_RE.sub(lambda m: _LONG[m[0]], t)
        clean.append(_TAG.sub(" ", t) if "<" in t or "&" in t else t)
    raw = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _table()
    codes = table[raw] if not raw.size or raw.max() < table.size else np.where(raw < table.size, table[np.minimum(raw, table.size - 1)], raw)
    return raw, np.cumsum([0, *map(len, clean)]), codes


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all texts one after another, start of each text in it and the end of the last)."""
    _, ends, codes = _raw(texts)
    kept = np.flatnonzero(codes)
    return codes[kept], np.searchsorted(kept, ends)


def sentence_bounds(texts: list[str]) -> np.ndarray:
    """Places in stream(texts) where a text, a sentence or a clause before a semicolon begins or ends, in order."""
    raw, ends, codes = _raw(texts)
    return np.unique(np.searchsorted(np.flatnonzero(codes), np.concatenate([ends, np.flatnonzero(np.isin(raw, _ENDING))])))


def slices(pdf: pd.DataFrame, text: str, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """A batch in parts of about so many characters; a longer text is a part of its own."""
    total = pdf[text].str.len().to_numpy().cumsum()
    for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(total // chars)) + 1):
        if at.size:
            yield pdf.iloc[at[0] : at[-1] + 1]


def is_han(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 0x3400) & (codes < 0xA000)) | (codes >= 0x20000)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def grams(codes: np.ndarray, short: int, long: int) -> np.ndarray:
    """Hash of the q-gram at every place: q = short where a Han character begins it, else long. short 6 and long 16 only.

    Built by doubling, so each place costs five multiply-adds. Places with too little text after them get 0.
    """
    assert (short, long) == (6, 16)
    n = codes.size
    out = np.zeros(n, dtype=np.uint64)
    if n < short:
        return out
    one = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        two = one[:-1] + _power(1) * one[1:]
        four = two[:-2] + _power(2) * two[2:]
        six = four[:-2] + _power(4) * two[4:]
        han = is_han(codes)
        at = np.flatnonzero(han[: six.size])
        out[at] = six[at]
        if n >= long:
            eight = four[:-4] + _power(4) * four[4:]
            sixteen = eight[:-8] + _power(8) * eight[8:]
            at = np.flatnonzero(~han[: sixteen.size])
            out[at] = sixteen[at]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))
