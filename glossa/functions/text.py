"""Normal forms, tokens and text predicates as column expressions; all but nfkc() run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa import constants as C

CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}"
#: Depth of nested brackets that is looked into.
NESTING = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


#: What compatibility normalisation never changes: ASCII, plain Latin letters, common Chinese characters and full-width-free punctuation.
_SETTLED = r"[^\x{0}-\x{9F}\x{A1}-\x{A7}\x{AB}-\x{AC}\x{AE}\x{B0}-\x{B1}\x{B6}-\x{B7}\x{BB}\x{BF}-\x{131}\x{3001}-\x{3029}\x{4E00}-\x{9FFF}]"


def compatible(v: Column) -> Column:
    """nfkc() as part of a column plan: only values with a character that it could change go through Python."""
    return F.when(v.rlike(_SETTLED), nfkc(F.when(v.rlike(_SETTLED), v))).otherwise(v)


def ascii_lower(v: Column) -> Column:
    """Lower case of A-Z alone, the order in which headwords are compared."""
    return F.translate(v, _UPPER, _LOWER)


def dictionary_key(v: Column) -> Column:
    """Trimmed, without syllable dots, in lower case."""
    return F.lower(F.regexp_replace(F.trim(v), "[·‧]", ""))


def straight_apostrophes(v: Column) -> Column:
    return F.translate(dictionary_key(v), "‘’‛＇", "''''")


def query_variants(v: Column) -> Column:
    """Distinct spellings of a query: as it is, with straight and with curly apostrophes."""
    straight = straight_apostrophes(v)
    return F.array_distinct(F.array(dictionary_key(v), straight, F.translate(straight, "'", "’")))


def spaced(v: Column) -> Column:
    """Runs of spaces, punctuation and symbols as one space; one variant character unified."""
    return F.trim(F.regexp_replace(F.translate(v, "矽", "硅"), r"[\s\p{Z}\p{P}\p{S}]+", " "))


def cjk_runs(v: Column) -> Column:
    """The maximal runs of Chinese characters."""
    return F.regexp_extract_all(v, F.lit(f"([{CJK}]+)"), F.lit(1))


def _pairs(run: Column) -> Column:
    return F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def index_tokens(runs: Column) -> Column:
    """Distinct single characters and pairs of neighbours of all runs."""
    singles = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda c: c != "")))
    return F.array_distinct(F.concat(singles, F.flatten(F.transform(runs, _pairs))))


def query_tokens(runs: Column) -> Column:
    """Distinct pairs of neighbours; a run of one character stands for itself."""
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(_pairs(r)))))


def has_negation(v: Column) -> Column:
    return v.rlike("[不没无未非莫别勿]|难[以于]")



def _held(runs: Column, part: Column) -> Column:
    return F.exists(runs, lambda r: F.contains(r, part))


def longest_common(query: Column, runs: Column) -> Column:
    """Length of the longest part of query within one run.

    One walk over the query: the part that begins here and is one longer than the best so far is either held by a run, then it is the best, or the walk
    goes on to the next beginning; 2 n tests for n characters.
    """
    n = F.length(query)
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("best"))

    def step(s: Column, _: Column) -> Column:
        more = F.when(s["at"] + s["best"] <= n, _held(runs, F.substring(query, s["at"], s["best"] + 1))).otherwise(F.lit(False))
        return F.struct(F.when(more, s["at"]).otherwise(s["at"] + 1).alias("at"), F.when(more, s["best"] + 1).otherwise(s["best"]).alias("best"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), 2 * n), start, step, lambda s: s["best"])).otherwise(0)


def holds_part(query: Column, runs: Column, length: Column) -> Column:
    """Whether a run holds some part of query of the given length."""
    starts = F.sequence(F.lit(1), F.length(query) - length + 1)
    return F.when((length > 0) & (F.size(runs) > 0), F.exists(starts, lambda i: _held(runs, F.substring(query, i, length)))).otherwise(F.lit(False))


def bigram_coverage(query: Column, runs: Column) -> Column:
    """Share of the query's neighbouring pairs, repeated ones included, that occur in a run."""
    n = F.length(query)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(query, i, F.lit(2)))
    hits = F.size(F.filter(pairs, lambda p: F.exists(runs, lambda r: F.contains(r, p))))
    return F.when(n >= 2, hits / (n - 1)).otherwise(F.when(F.exists(runs, lambda r: F.contains(r, query)), 1.0).otherwise(0.0))


def leading_coverage(query: Column, runs: Column) -> Column:
    """Share of the query that the longest of its beginnings found in a run makes up."""
    n = F.length(query)
    further = lambda k, i: F.when((k == i - 1) & _held(runs, F.substring(query, F.lit(1), i)), i).otherwise(k)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), further) / n).otherwise(0.0)


def segment_quality(query: Column, runs: Column) -> Column:
    """struct(exact, extension, boundary, compactness, position) of the query's first place in each run."""
    n = F.length(query)

    def of(r: Column, i: Column) -> Column:
        at, size = F.instr(r, query), F.length(r)
        return F.when(
            at > 0,
            F.struct(
                (size == n).alias("exact"),
                ((size == n + 1) & (at == 1) & F.substring(r, n + 1, F.lit(1)).isin("的", "地", "得")).alias("extension"),
                ((at == 1) | (at - 1 + n == size)).alias("boundary"),
                (n / size).alias("compactness"),
                (F.lit(1.0) / (i + 1)).alias("position"),
            ),
        )

    found = F.filter(F.transform(runs, of), lambda x: x.isNotNull())
    any_ = lambda f: F.exists(found, lambda x: x[f])
    best = lambda f: F.coalesce(F.array_max(F.transform(found, lambda x: x[f])), F.lit(0.0))
    return F.struct(any_("exact").alias("exact"), any_("extension").alias("extension"), any_("boundary").alias("boundary"), best("compactness").alias("compactness"), best("position").alias("position"))


def outside_brackets(v: Column) -> Column:
    """The text with each outermost bracketed part replaced by a bracket: what a closing bracket without an opening one, or the reverse, leaves stands outside or inside.

    Brackets of all kinds count alike. Inner parts are taken out first, as often as brackets nest (up to NESTING deep).
    """
    one = F.translate(F.translate(v, C.OPENING, "\x01" * len(C.OPENING)), C.CLOSING, "\x02" * len(C.CLOSING))
    for _ in range(NESTING):
        one = F.regexp_replace(one, "\x01[^\x01\x02]*\x02", "\x03")
    return F.regexp_replace(one, "(?s)\x01.*$", "\x03")


def bracket_views(v: Column) -> tuple[Column, Column]:
    """(text with brackets as separators, text outside brackets): what stands only inside brackets is found in the first alone."""
    text = F.translate(v, "矽", "硅")
    held = F.translate(text, C.OPENING + C.CLOSING, "\x03" * len(C.OPENING + C.CLOSING))
    bracketed = held.rlike("\x03")
    return held, F.when(bracketed, outside_brackets(text)).otherwise(held)


def only_in_brackets(v: Column, query: Column) -> Column:
    """Whether query occurs in v, but nowhere outside brackets; places that span a bracket don't count."""
    held, outside = bracket_views(v)
    return (F.length(query) > 0) & F.contains(held, query) & ~F.contains(outside, query)


_OTHER = r"[\p{L}\p{N}&&[^\p{ASCII}]&&[^\p{IsHan}]]"
_BEFORE, _AFTER = rf"(?<!{_OTHER}[-']{{0,8}})", rf"(?![-']{{0,8}}{_OTHER})"


def _plain(v: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(v, "[ˈˌ]", ""), "[‐‑‒–—−]", "-"))


def headword_tokens(v: Column) -> Column:
    """ASCII words with inner hyphens and apostrophes, none that touches a letter of another script."""
    return F.regexp_extract_all(_plain(v), F.lit(rf"{_BEFORE}(?<![a-z0-9])([a-z0-9]+(?:[-'][a-z0-9]+)*){_AFTER}(?![a-z0-9])"), F.lit(1))


def headword_term(v: Column) -> Column:
    return F.array_join(headword_tokens(v), " ")


def filter_tokens(v: Column) -> Column:
    """As headword_tokens, but hyphens and apostrophes part words."""
    return F.regexp_extract_all(_plain(v), F.lit(rf"{_BEFORE}(?<![a-z0-9])([a-z0-9]+){_AFTER}(?![a-z0-9])"), F.lit(1))


_TOKEN = rf"{_BEFORE}(?<![a-z0-9])[a-z0-9]+(?:[-'][a-z0-9]+)*{_AFTER}(?![a-z0-9])"


def anchor_terms(v: Column) -> Column:
    """Headwords that a query may name, in order: each phrase of ASCII words with nothing but spaces between, then its words.

    Words and phrases of stop words alone are left out unless the query has no others.
    """
    telling = lambda x: F.size(significant_terms(filter_tokens(x))) > 0
    phrases = F.regexp_extract_all(_plain(v), F.lit(rf"({_TOKEN}(?:\s+{_TOKEN})*)"), F.lit(1))
    any_telling = telling(v)
    of = lambda p: F.concat(F.array(headword_term(p)), F.filter(headword_tokens(p), lambda t: ~any_telling | telling(t)))
    return F.array_distinct(F.flatten(F.transform(F.filter(phrases, lambda p: ~any_telling | telling(p)), of)))


def significant_terms(terms: Column) -> Column:
    return F.array_except(terms, F.array(*map(F.lit, C.STOP_WORDS)))


def evidence_hits(terms: Column, *fields: Column) -> Column:
    """struct(significant, all): distinct query terms found in any field; without significant terms all count as such."""
    there = F.flatten(F.array(*(F.coalesce(filter_tokens(f), F.array().cast("array<string>")) for f in fields)))
    distinct, strong = F.array_distinct(terms), significant_terms(F.array_distinct(terms))
    every = F.size(F.array_intersect(distinct, there))
    return F.struct(F.when(F.size(strong) > 0, F.size(F.array_intersect(strong, there))).otherwise(every).alias("significant"), every.alias("all"))


def planner_tokens(v: Column) -> Column:
    """Words of letters and digits in any script, inner apostrophes straightened."""
    return F.regexp_extract_all(F.translate(F.lower(F.trim(v)), "’", "'"), F.lit(r"([\p{L}\p{Nd}]+(?:['-][\p{L}\p{Nd}]+)*)"), F.lit(1))


def query_signature(v: Column) -> Column:
    """What is left of a query without case, spaces, punctuation and symbols."""
    return F.regexp_replace(F.lower(v), r"[\s\p{Z}\p{P}\p{S}]", "")


def normalized_headword(v: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(v, "[·ˈˌ]", ""), r"\s+", " ")))


def stems(v: Column) -> Column:
    """Up to two regular stems of an inflected word of letters a-z, in the order they should be tried; a stem has three letters at least."""
    cut = lambda n, tail="": F.concat(F.substring(v, F.lit(1), F.length(v) - n), F.lit(tail))
    # a doubled consonant before the ending is written once in the stem
    of = lambda n: F.when(cut(n).rlike(r"([^aeiou])\1$"), F.array(cut(n + 1))).otherwise(F.array(cut(n), cut(n, "e")))
    ends = lambda tail, least: F.endswith(v, F.lit(tail)) & (F.length(v) > least)
    made = (
        F.when(~v.rlike("^[a-z]+$"), F.array().cast("array<string>"))
        .when(ends("ied", 4) | (ends("ies", 4)), F.array(cut(3, "y")))
        .when(ends("ed", 4), of(2))
        .when(ends("ing", 5), of(3))
        .when(ends("es", 4), F.array(cut(2)))
        .when(ends("s", 3), F.array(cut(1)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.slice(F.array_distinct(F.filter(made, lambda x: (F.length(x) >= 3) & (x != v))), 1, 2)


def ranked(v: Column, ranks: dict[str, int], otherwise: int = -1) -> Column:
    """Rank of an enumeration value."""
    return reduce(lambda c, kv: c.when(v == kv[0], kv[1]), list(ranks.items())[1:], F.when(v == next(iter(ranks)), next(iter(ranks.values())))).otherwise(otherwise)


def metadata_labels(v: Column) -> Column:
    """array<struct<text,kind>> of the bracketed codes in a text: frequency, level, register and exam labels."""
    codes = F.transform(F.regexp_extract_all(v, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x))

    def of(c: Column) -> Column:
        up, found = F.upper(c), lambda kind, text: F.struct(text.alias("text"), F.lit(kind).alias("kind"))
        return (
            F.when(c.rlike(r"(?i)^Ox(3000|5000)\b"), found("frequency", F.substring(c, 3, 4)))
            .when(c.rlike("(?i)^CEFR_([A-C][12])(_|$)"), found("level", F.substring(up, 6, 2)))
            .when(c.rlike("(?i)^OPAL_[OSW]$"), found("academic-register", F.substring(up, 6, 1)))
            .when(c.rlike(r"(?i)^(CET\d+|NETM|TEM\d+|IELTS|TOEFL|GRE)$"), found("exam", up))
            .when(c.rlike("(?i)^[A-C][12]$"), found("level", up))
        )

    return F.filter(F.transform(codes, of), lambda x: x.isNotNull())


def label_weight(labels: Column) -> Column:
    """Level weight plus frequency weight of an entry's labels."""
    best = lambda kind, ranks: F.coalesce(F.array_max(F.transform(F.filter(labels, lambda x: x["kind"] == kind), lambda x: ranked(x["text"], ranks, 0))), F.lit(0))
    return best("level", C.LEVEL_WEIGHT) + best("frequency", C.FREQUENCY_WEIGHT)


def reference_kind(label: Column) -> Column:
    """Kind of a cross-reference by its label; generic where there is none."""
    normal = F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), "^(?:->|→)\\s*", ""), r"\s+", " "))
    kinds = F.create_map(*(F.lit(x) for kv in C.REFERENCE_KINDS.items() for x in kv))
    return F.coalesce(kinds[normal], F.lit("generic"))


def prefixed_category(kind: Column, categories: list[tuple[str, str]]) -> Column:
    """Category of the first source type that is the value or begins it as a whole word; else 'other'."""
    normal = F.upper(F.regexp_replace(F.trim(kind), r"\s+", " "))
    out = F.when(normal.isNull() | (normal == ""), "other")
    for source, category in categories:
        out = out.when((normal == source) | F.startswith(normal, F.lit(source + " ")), category)
    return out.otherwise("other")


def media_url(key: Column, template: str) -> Column:
    """URL of a media key from a template with {key} and {prefix1|3|5}; null for a key that is empty, too long or a path."""
    valid = (F.octet_length(key) > 0) & (F.octet_length(key) <= 512) & ~key.rlike(r"[/\\]") & ~key.isin(".", "..")
    escape = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    out = F.lit(template)
    for n in (1, 3, 5):
        out = F.replace(out, F.lit(f"{{prefix{n}}}"), escape(F.substring(F.lower(key), 1, n)))
    return F.when(valid, F.replace(out, F.lit("{key}"), escape(key)))


def link_target(href: Column) -> Column:
    """struct(term, article) of an internal link /word/<term>#<article>; null for any other link."""
    term = F.regexp_extract(href, r"^(?:https?://[^/]+)?/word/([^/?#]+)", 1)
    article = F.regexp_extract(href, r"#(.+)$", 1)
    return F.when(term != "", F.struct(F.try_url_decode(term).alias("term"), F.nullif(article, F.lit("")).alias("article")))


def preview(v: Column, most: int = 512) -> Column:
    """Text on one line, cut to `most` characters with an ellipsis of three dots."""
    line = F.trim(F.regexp_replace(v, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("..."))).otherwise(line)


def unwrapped(v: Column) -> Column:
    """The inside of a label that is wholly in parentheses."""
    return F.when(v.rlike(r"^\(.*\)$"), F.trim(F.regexp_replace(v, r"^\(|\)$", ""))).otherwise(v)


def path_key(path: Column) -> Column:
    """Path segments, percent-encoded, joined by slashes."""
    return F.array_join(F.transform(path, lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def location_contains(outer_section: Column, outer_path: Column, outer_owner: Column, section: Column, path: Column, owner: Column) -> Column:
    """Whether a location lies within another: same section and a deeper path, or the same path with no other owner."""
    n = F.size(outer_path)
    deeper = (F.size(path) > n) & (F.slice(path, F.lit(1), F.greatest(n, F.lit(1))) == outer_path)
    same = (path == outer_path) & (outer_owner.isNull() | owner.isNull() | (outer_owner == owner))
    return (outer_section == section) & (F.when(n == 0, F.size(path) > 0).otherwise(deeper) | same)


def token_at(v: Column, offset: Column, most: int = 80) -> Column:
    """The word at a character offset, null where none is or it is too long."""
    left = F.regexp_extract(F.substring(v, F.lit(1), offset), r"([\p{L}\p{N}'’-]*)$", 1)
    right = F.regexp_extract(F.substring(v, offset + 1, F.length(v)), r"^([\p{L}\p{N}'’-]*)", 1)
    word = F.regexp_replace(F.concat(left, right), "^['’-]+|['’-]+$", "")
    return F.when((F.length(word) > 0) & (F.length(word) <= most), word)
