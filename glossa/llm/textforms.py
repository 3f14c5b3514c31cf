"""Visually equal text in one form: compatibility composition, full case folding, mapped spaces,
removed invisible characters, and look-alike letters of other scripts.

Defined results: null stays null and is never marked; empty text stays empty; the length of a text
is not limited; equal values give equal results. Only the characters decide, so extra columns and
repeated rows have no influence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that are drawn like a Latin letter (lower and upper case).
LOOKALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "ԍ": "g", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D",
    # Greek
    "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ք": "p", "գ": "q", "լ": "l", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
}

# Letters that pass for a Latin one only among Latin letters.
LOOKALIKE_AMONG_LATIN = {"в": "b", "ғ": "f", "к": "k", "м": "m", "п": "n", "г": "r", "т": "t", "и": "u", "ε": "e", "η": "n", "τ": "t", "χ": "x", "γ": "y", "ω": "w", "ռ": "n", "σ": "o", "β": "b"}

# Letters of the Latin script itself that are drawn like a plain one.
LATIN_LOOKALIKE = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ʟ": "l", "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ɪ": "i", "ȷ": "j", "ꞵ": "b"}

# Kana and other signs that are drawn like a Chinese character.
KANA_LOOKALIKE = {"ニ": "二", "ロ": "口", "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ハ": "八", "ミ": "三", "ヘ": "へ", "チ": "千", "ム": "厶", "メ": "乄", "ヒ": "匕", "ー": "一"}

# Radicals with a code of their own but no compatibility mapping, and the character each is drawn like.
RADICALS = {
    "⺀": "冫", "⺁": "厂", "⺂": "乛", "⺃": "乚", "⺄": "乙", "⺅": "亻", "⺆": "冂", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺋": "㔾",
    "⺌": "小", "⺍": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺕": "彐", "⺖": "忄", "⺗": "㣺",
    "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫",
    "⺥": "爫", "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺫": "目", "⺬": "示", "⺭": "礻", "⺯": "糹", "⺰": "纟", "⺱": "罓",
    "⺲": "罒", "⺳": "㓁", "⺶": "羊", "⺹": "耂", "⺺": "肀", "⺻": "聿", "⺼": "月", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎",
    "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶",
    "⻎": "辶", "⻏": "邑", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦",
    "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟",
    "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜",
    "⻲": "亀",
}

# Ranges of characters that are ignorable by default, besides the format characters.
IGNORABLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
# Format characters that are drawn: number signs and marks before numbers, interlinear marks, hieroglyph joiners.
DRAWN = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F))
# Kinds of compatibility mapping that keep the look of the character.
SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}

#: Ordinary line breaks and tabs.
BREAKS = "\t\n\r\v\f\x1c\x1d\x1e\x1f\x85  "
#: Characters of which any sequence is already in composed, visible, one-script form (Java and Python syntax).
PLAIN = r"\x20-\x7EÀ-ÖØ-Þà-öø-ÿ–—‘’“”、。〈-】一-鿿！（），：；？"
ODD = f"[^{PLAIN}]"


def _ignorable(c: str) -> bool:
    """Ignorable by default: format characters but for those that are drawn, and the ranges above."""
    within = lambda ranges: any(a <= ord(c) <= b for a, b in ranges)
    return within(IGNORABLE) or (unicodedata.category(c) == "Cf" and not within(DRAWN))


class _Lazy(dict):
    """Table for str.translate that works a character out when it is first met."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int):
        self[code] = found = self.rule(chr(code))
        return found


def _visible(c: str) -> str:
    if _ignorable(c):
        return ""
    if c in BREAKS:
        return c
    return " " if c.isspace() else RADICALS.get(c, c)


def _ordinary(c: str) -> str:
    """What a character of a plain spelling becomes in the consistent form: folded case, and punctuation, symbols and forms of another look as compatibility maps them.

    Variant forms of letters, digits and Chinese characters stay as they are, so that a text that holds one differs from its consistent form.
    """
    mapped = unicodedata.decomposition(c).split()
    kind = mapped[0] if mapped else ""
    letter = unicodedata.category(c)[0] in "LNM" or 0x2E80 <= ord(c) <= 0x2FDF
    if letter and (c in RADICALS or kind in SAME_LOOK or (kind[:1] not in ("", "<") and unicodedata.normalize("NFC", c) != c)):
        return c
    if c.isspace() or _ignorable(c):
        return c
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold())


VISIBLE, ORDINARY = _Lazy(_visible), _Lazy(_ordinary)
_FOREIGN = re.compile("[Ͱ-֏]")
_WORD = re.compile(r"[^\W\d_⺀-鿿가-힣]+")
_LATIN = re.compile("[A-Za-z]")
_TO_LATIN = str.maketrans(LOOKALIKE)
_TO_LATIN_AMONG = str.maketrans(LOOKALIKE | LOOKALIKE_AMONG_LATIN)
_LATIN_FORM = str.maketrans(LATIN_LOOKALIKE)
_KANA_RUN = re.compile(r"[゠-ヿ]+")
_SPACES = re.compile(r"\s+")
_BREAKS = re.compile(f"[ {BREAKS}]+")


def _han(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _word(m: re.Match) -> str:
    """A word of foreign letters is Latin in disguise if it mixes with Latin or consists of look-alikes only."""
    if not _FOREIGN.search(m[0]):
        return m[0]
    word = unicodedata.normalize("NFD", m[0])
    if _LATIN.search(word):
        return unicodedata.normalize("NFC", word.translate(_TO_LATIN_AMONG))
    return word.translate(_TO_LATIN) if all(c in LOOKALIKE for c in word) else m[0]


def _kana(m: re.Match) -> str:
    """A lone kana beside a Chinese character is that character's look-alike; longer runs are words."""
    run, text = m[0], m.string
    beside = (m.start() > 0 and _han(text[m.start() - 1])) or (m.end() < len(text) and _han(text[m.end()]))
    return KANA_LOOKALIKE.get(run, run) if len(run) == 1 and beside else run


def unmasked(text: str) -> str:
    """Look-alikes put back into the script of their word."""
    text = text.translate(_LATIN_FORM)
    if _FOREIGN.search(text):
        text = _WORD.sub(_word, text)
    return _KANA_RUN.sub(_kana, text)


def canonical(text: str) -> str:
    """The one form in which equal-looking texts are equal."""
    shown = unicodedata.normalize("NFKC", text.translate(VISIBLE))
    folded = unmasked(shown.translate(VISIBLE)).casefold()
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", folded)).strip()


def disguised(text: str) -> bool:
    """Whether text looks like a plain spelling but holds other characters: whether its consistent form differs from what folded case,
    ordinary punctuation and collapsed breaks alone would make of it.

    Punctuation, letter case, ordinary line breaks and composed accents never count.
    """
    return canonical(text) != _BREAKS.sub(" ", text.translate(ORDINARY)).strip(" " + BREAKS)


def _per_distinct(values: pd.Series, rule, kind) -> pd.Series:
    """rule over the distinct values of a batch only, spread to its rows."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    results = pd.Series([rule(v) for v in distinct], dtype=object)
    out = results.reindex(codes)
    out.index = values.index
    return out.where(codes >= 0, None).astype(kind)


@F.pandas_udf(T.StringType())
def _canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield _per_distinct(values, canonical, object)


@F.pandas_udf(T.BooleanType())
def _disguised_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield _per_distinct(values, disguised, object)


# Punctuation of PLAIN and its compatibility form.
_PUNCTUATION = ("！（），：；？", "!(),:;?")


def canonical_column(value: Column) -> Column:
    """canonical() as a column. Values of plain characters alone stay in the JVM."""
    plain = F.trim(F.regexp_replace(F.lower(F.translate(value, *_PUNCTUATION)), " +", " "))
    return F.when(value.rlike(ODD), _canonical_udf(value)).otherwise(plain)


def odd(value: Column) -> Column:
    """Whether a value needs a closer look at all; computed in the JVM, true for every disguised value."""
    return value.rlike(ODD)


def disguised_column(value: Column) -> Column:
    """disguised() as a column; to be used on values for which odd() holds."""
    return _disguised_udf(value)
