"""English planner: which stored phrases and words a query of several words is made of.

Every query's probes meet the index in one join. Making the probes and choosing phrases that don't overlap are sequential
within one query (at most MOST_PROBES phrases) and run in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa import constants as C
from glossa.functions import text as X
from glossa.functions import typo
from glossa.session import stored

MOST_TOKENS, LONGEST, MOST_PROBES, MOST_CORRECTIONS, MOST_GROUPS = 12, 5, 24, 8, 8


_INT, _TEXT = T.IntegerType(), T.StringType()
PHRASE = T.ArrayType(T.StructType().add("order", _INT).add("text", _TEXT).add("surface", _TEXT).add("places", T.ArrayType(_INT)))
PROBES = T.StructType().add("phrases", PHRASE).add("tokens", T.ArrayType(T.StructType().add("text", _TEXT).add("place", _INT)))
_LIGHT = frozenset(C.LIGHT_WORDS)


def query_probes(words: list[str]) -> dict:
    """Phrases and words to look up for a query's words.

    Phrases are the spans of LONGEST down to 2 words from left to right, each followed by itself without light words;
    a span of light words only is none, and a text is probed once. Words are the distinct informative ones of a longer query.
    """
    words = list(words[:MOST_TOKENS])
    firm = [w not in _LIGHT for w in words]
    phrases: dict[str, dict] = {}
    for length in range(min(LONGEST, len(words)), 1, -1):
        for start in range(len(words) - length + 1):
            span = range(start, start + length)
            surface = " ".join(words[start : start + length])
            for places in (list(span), [i for i in span if firm[i]]):
                text = " ".join(words[i] for i in places)
                if len(places) > 1 and any(firm[i] for i in span) and len(phrases) < MOST_PROBES and text not in phrases:
                    phrases[text] = {"order": len(phrases), "text": text, "surface": surface, "places": places}
    tokens = {w: {"text": w, "place": words.index(w)} for i, w in enumerate(words) if firm[i]} if len(words) > 1 else {}
    return {"phrases": list(phrases.values()), "tokens": list(tokens.values())}


def chosen(found, most: int = MOST_GROUPS - 1) -> list[dict]:
    """Of stored phrases in the order they were probed, those that share no place with one taken before, in order of place."""
    taken, used = [], set()
    for p in sorted(found, key=lambda p: p["order"]):
        if len(taken) < most and used.isdisjoint(p["places"]):
            taken.append(p)
            used.update(p["places"])
    return sorted(taken, key=lambda p: p["places"][0])


@F.pandas_udf(PROBES)
def _probes_udf(words: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([query_probes(w) for w in words], columns=["phrases", "tokens"])


@F.pandas_udf(PHRASE)
def _chosen_udf(found: pd.Series) -> pd.Series:
    return found.map(lambda f: [] if f is None else chosen(f))


def probes(queries: DataFrame) -> DataFrame:
    """(query_id, exact, phrases, tokens, corrections): what to look up for each query (query_id, query) that has a word."""
    base = queries.select("query_id", X.planner_tokens(F.col("query")).alias("words")).filter(F.size("words") > 0)
    first = F.element_at("words", 1)
    single = F.when((F.size("words") == 1) & typo.eligible(first), F.slice(typo.direct_candidates(first), 1, MOST_CORRECTIONS)).otherwise(F.array().cast("array<string>"))
    made = base.select("query_id", F.array_join("words", " ").alias("exact"), _probes_udf("words").alias("p"), single.alias("corrections"))
    return made.select("query_id", "exact", "p.phrases", "p.tokens", "corrections")


def plan(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, kind, place, text, surface, known): the groups of each query: exact alone if stored, else phrases, words and a correction.

    terms: (term) that are stored. Words are listed whether they are stored or not, as long as no chosen phrase covers them.
    """
    index = terms.select("term").distinct().withColumn("known", F.lit(True))
    made = stored(probes(queries), "english-probes")  # read by every branch below
    exact = made.join(index.withColumnRenamed("term", "exact"), "exact", "left_semi").select("query_id", "exact")
    rest = made.join(exact.select("query_id"), "query_id", "left_anti")
    hits = rest.select("query_id", F.inline("phrases")).join(index, F.col("text") == F.col("term"), "left_semi")
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("order", "text", "surface", "places"))).alias("found"))  # at most MOST_PROBES
    picked = rest.select("query_id", "tokens").join(per, "query_id", "left").withColumn("picked", _chosen_udf("found"))
    phrases = picked.select("query_id", F.posexplode("picked").alias("at", "p")).select("query_id", F.lit("phrase").alias("kind"), "at", "p.text", "p.surface")
    covered = F.flatten(F.transform("picked", lambda p: p["places"]))
    room = F.lit(MOST_GROUPS - 1) - F.size("picked")
    open_ = F.filter("tokens", lambda t: ~F.array_contains(covered, t["place"]))
    left = F.when(room > 0, F.slice(open_, F.lit(1), F.greatest(room, F.lit(0)))).otherwise(F.array().cast("array<struct<text:string,place:int>>"))
    words = picked.select("query_id", F.inline(left)).select("query_id", F.lit("word").alias("kind"), F.col("place").alias("at"), "text", F.col("text").alias("surface"))
    tried = rest.select("query_id", F.posexplode("corrections").alias("at", "text")).join(index, F.col("text") == F.col("term"), "left_semi")
    first = tried.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).filter("_n = 1")
    corrections = first.select("query_id", F.lit("correction").alias("kind"), "at", "text", F.col("text").alias("surface"))
    whole = exact.select("query_id", F.lit("exact").alias("kind"), F.lit(0).alias("at"), F.col("exact").alias("text"), F.col("exact").alias("surface"))
    groups = whole.unionByName(phrases).unionByName(words).unionByName(corrections)
    return groups.join(index, F.col("text") == F.col("term"), "left").select("query_id", "kind", F.col("at").alias("place"), "text", "surface", F.coalesce("known", F.lit(False)).alias("known"))
