"""Candidates of a search: every query against shelves of documents that stand in the order in which pools are cut.

A task counts the shared tokens of all queries of a block over the postings of one shelf, so no pair of a query and a document is
shuffled. How many candidates the shelves before hold says which of a shelf are among the first of their query and pool.
Queries with a word that few documents hold need no shelves: only those documents are looked at (see by_word).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa import constants as C
from glossa.functions import text as X
from glossa.session import stored, stored_parts

#: Documents to a shelf and queries to a block.
SHELF, QUERY_BLOCK = 50_000, 4096
POOLS = 1 + max(C.POOL_TIER.values())
#: Texts and words are broadcast up to so many, else joined by shuffle.
BROADCAST_WORDS = 500_000


def _name() -> Column:
    """The text of a document in which the words of a query must stand."""
    return X.ascii_lower(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in ("headword", "english_text", "chinese_text"))))


def by_word(asked: DataFrame, docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, pool, shared, n, least), query_id): candidates of queries with a word that at most `limit` documents hold, and these queries.

    No pool of such a query can be cut, so its candidates are the documents of its rarest word that hold the other words too and share a token.
    asked, docs: as for Pools. A word lies within a run of a-z and 0-9; the distinct runs are searched for all words at once.
    """
    words = asked.select("query_id", F.explode("words").alias("word"))
    each = words.select("word").distinct()
    longest = each.agg(F.max(F.length("word"))).first()[0] or 0
    named = docs.filter(F.lit(longest > 0)).select("id", "pool", "runs", _name().alias("name"))  # without words no document is read
    named = named.withColumn("_runs", F.array_distinct(F.regexp_extract_all("name", F.lit("([a-z0-9]+)"), F.lit(1))))
    sizes = named.select(F.explode("_runs").alias("run")).groupBy("run").agg(F.count("*").alias("documents"))
    starts, lengths = F.sequence(F.lit(1), F.length("run")), lambda i: F.sequence(F.lit(1), F.least(F.length("run") - i + 1, F.lit(longest)))
    parts = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda k: F.substring("run", i, k)))))
    within = stored(sizes.select("run", "documents", F.explode(parts).alias("word")).join(each, "word"), "reverse-runs")
    # a document counts once for each run that holds the word: that is never too few
    held = words.join(within.groupBy("word").agg(F.sum("documents").alias("documents")), "word", "left")
    rarest = held.groupBy("query_id").agg(F.min(F.struct(F.coalesce("documents", F.lit(0)).alias("documents"), "word")).alias("_r")).filter(F.col("_r.documents") <= limit)
    rare = stored(asked.join(rarest.select("query_id", F.col("_r.word").alias("word")), "query_id"), "reverse-rare")
    runs = within.join(rare.select("word").distinct(), "word").select("run", "word")
    sent = F.broadcast(runs) if runs.count() <= BROADCAST_WORDS else runs
    there = named.withColumn("run", F.explode("_runs")).join(sent, "run").select("id", "pool", "runs", "name", "word").join(rare, "word")
    shared = F.size(F.filter("tokens", lambda t: F.exists("runs", lambda r: F.contains(r, t))))
    met = there.filter(F.forall("words", lambda w: F.contains("name", w))).select("query_id", "id", "pool", shared.alias("shared"), F.size("tokens").alias("n"), "least")
    return stored(met.filter("shared > 0").distinct(), "reverse-by-word"), rare.select("query_id")


@dataclass
class Block:
    """Queries of a block: their ids, numbers of their tokens in the vocabulary (codes in order), words, and the tokens that a near match shares at least."""

    ids: np.ndarray
    tokens: list[np.ndarray]
    vocabulary: np.ndarray
    words: list[list[str]]
    least: np.ndarray


def shelves(docs: DataFrame, named: bool) -> DataFrame:
    """(shelf, ids, pools, texts, names): documents by pool, weight, entry and id; texts one to a line with tabs between the runs, names likewise or empty.

    docs: prepared_documents() with entry_id, headword and english_text.
    """
    order = [F.desc("pool"), F.desc(F.coalesce("weight", F.lit(0))), "entry_id", "id"]
    name = F.translate(_name(), "\n", " ") if named else F.lit("")
    rows = docs.select("id", "pool", "weight", "entry_id", F.array_join("runs", "\t").alias("text"), name.alias("name"))
    placed = rows.repartitionByRange(max(1, -(-rows.count() // SHELF)), *order).sortWithinPartitions(*order).select("id", "pool", "text", "name")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = [pdf for pdf in batches if len(pdf)]
        if there:
            rows = pd.concat(there)
            yield pd.DataFrame({"shelf": [TaskContext.get().partitionId()], "ids": [rows["id"].to_numpy()], "pools": [rows["pool"].to_numpy()], "texts": ["\n".join(rows["text"])], "names": ["\n".join(rows["name"])]})

    kind = docs.schema["id"].dataType.simpleString()
    return stored(placed.mapInPandas(packed, f"shelf int, ids array<{kind}>, pools array<int>, texts string, names string"), "reverse-shelves")


def _code(token: str) -> int:
    return ord(token) if len(token) == 1 else ord(token[0]) << 21 | ord(token[1])


def block(rows: pd.DataFrame) -> Block:
    """rows: query_id, tokens, words, least."""
    codes = [np.array([_code(t) for t in tokens], dtype=np.int64) for tokens in rows["tokens"]]
    vocabulary = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *codes]))
    return Block(rows["query_id"].to_numpy(), [np.searchsorted(vocabulary, c) for c in codes], vocabulary, [list(w) for w in rows["words"]], rows["least"].to_numpy())


def _postings(texts: str, n: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, where those of each token begin) of the single characters and neighbouring pairs in the vocabulary."""
    c = np.frombuffer(texts.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    line = np.cumsum(c == 10)
    code, doc = np.concatenate([c, c[:-1] << 21 | c[1:]]), np.concatenate([line, line[:-1]])
    at = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
    here = vocabulary[at] == code
    token, doc = np.divmod(np.unique(at[here] * n + doc[here]), n)
    return doc, np.searchsorted(token, np.arange(len(vocabulary) + 1))


def _holders(names: str, n: int, words: set[str]) -> dict[str, np.ndarray]:
    """For each word whether it stands somewhere in the name of a document, as text: a word of a-z and 0-9 lies within a run of these."""
    if not words:
        return {}
    runs: dict[str, list[int]] = {}
    for i, name in enumerate(names.split("\n")):
        for run in re.findall("[a-z0-9]+", name):
            runs.setdefault(run, []).append(i)
    every, text = list(runs), "\n".join(runs)
    starts, out = np.cumsum([0, *(len(r) + 1 for r in every)]), {}
    for word in words:
        found, at = out.setdefault(word, np.zeros(n, dtype=bool)), text.find(word)
        while at >= 0:
            k = int(np.searchsorted(starts, at, side="right")) - 1
            found[runs[every[k]]] = True
            at = text.find(word, int(starts[k + 1]))
    return out


def _met(row: dict, asked: Block, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of a wanted query, documents of the shelf that share a token and hold its words, how many tokens they share)."""
    n = len(row["ids"])
    if not len(asked.vocabulary):
        return
    doc, starts = _postings(row["texts"], n, asked.vocabulary)
    wanted = [q for q in wanted if len(asked.tokens[q])]
    held = _holders(row["names"], n, {w for q in wanted for w in asked.words[q]})
    for q in wanted:
        shared = np.bincount(np.concatenate([doc[starts[t] : starts[t + 1]] for t in asked.tokens[q]]), minlength=n)
        for word in asked.words[q]:
            shared[~held[word]] = 0
        found = np.flatnonzero(shared)
        if len(found):
            yield q, found, shared[found]


def _shelf_rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        yield from pdf.to_dict("records")


class Pools:
    """First candidates of each query and pool; asked: (query_id, tokens, words, least), docs: prepared_documents()."""

    def __init__(self, asked: DataFrame, docs: DataFrame, limit: int):
        self.spark, self.limit, self.id_type = docs.sparkSession, limit, docs.schema["id"].dataType.simpleString()
        self.query_type = asked.schema["query_id"].dataType.simpleString()
        self.shelves = shelves(docs, asked.filter("size(words) > 0").limit(1).count() > 0)
        self.blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        self.asked, self.before = asked, {}

    def _of(self, df: DataFrame, k: int) -> pd.DataFrame:
        return df.filter(F.pmod(F.xxhash64("query_id"), F.lit(self.blocks)) == k).toPandas()

    def _counted(self, k: int, asked) -> tuple[dict, dict]:
        """By shelf the candidates of each query and pool that stand on the shelves before: those with any token and those with every one, up to the limit."""
        if k not in self.before:

            def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for row in _shelf_rows(batches):
                    some, every = np.zeros((2, len(asked.value.ids), POOLS), dtype=np.int32)
                    for q, found, shared in _met(row, asked.value, np.arange(len(some))):
                        pools = row["pools"][found]
                        some[q] = np.bincount(pools, minlength=POOLS)
                        every[q] = np.bincount(pools[shared == len(asked.value.tokens[q])], minlength=POOLS)
                    yield pd.DataFrame({"shelf": [row["shelf"]], "some": [some.tobytes()], "every": [every.tobytes()]})

            out = self.shelves.mapInPandas(count, "shelf int, some binary, every binary").toPandas().sort_values("shelf")
            before: tuple[dict, dict] = {}, {}
            for to, column in zip(before, ("some", "every"), strict=True):
                total = np.zeros((len(asked.value.ids), POOLS), dtype=np.int32)
                for shelf, counts in zip(out["shelf"], out[column], strict=True):
                    to[int(shelf)] = total.astype(np.int16)
                    total = np.minimum(total + np.frombuffer(counts, dtype=np.int32).reshape(total.shape), self.limit)
            self.before[k] = before
        return self.before[k]

    def _picked(self, whole: bool, settled: DataFrame | None) -> Iterator[DataFrame]:
        limit, context = self.limit, self.spark.sparkContext
        for k in range(self.blocks):
            made = block(self._of(self.asked, k))
            asked = context.broadcast(made)
            before = context.broadcast(self._counted(k, asked)[whole])
            done = np.zeros((len(made.ids), POOLS), dtype=bool)
            if settled is not None:
                pairs, number = self._of(settled, k), {q: i for i, q in enumerate(made.ids)}
                done[[number[q] for q in pairs["query_id"]], pairs["pool"]] = True

            def pick(batches: Iterator[pd.DataFrame], asked=asked, before=before, done=done) -> Iterator[pd.DataFrame]:
                for row in _shelf_rows(batches):
                    room = np.where(done, 0, limit - before.value[row["shelf"]])
                    queries, ids, pools = [], [], []
                    for q, found, shared in _met(row, asked.value, np.flatnonzero(room.max(axis=1) > 0)):
                        pool = row["pools"][found]
                        n = len(asked.value.tokens[q])
                        if whole:
                            found, pool = (found[shared == n], pool[shared == n]) if n > 1 else (found[:0], pool[:0])
                        for p in np.unique(pool):
                            first = np.flatnonzero(pool == p)[: max(0, room[q, p])]
                            if not whole:
                                first = first[shared[first] >= asked.value.least[q]]
                            queries.append(np.full(len(first), q))
                            ids.append(row["ids"][found[first]])
                            pools.append(pool[first])
                    if queries:
                        yield pd.DataFrame({"query_id": asked.value.ids[np.concatenate(queries)], "id": np.concatenate(ids), "pool": np.concatenate(pools)})

            yield self.shelves.mapInPandas(pick, f"query_id {self.query_type}, id {self.id_type}, pool int")
            asked.destroy()
            before.destroy()

    def whole(self) -> DataFrame:
        """(query_id, id, pool): the first documents with every token, for queries of several tokens."""
        return stored_parts(self.spark, self._picked(True, None), f"query_id {self.query_type}, id {self.id_type}, pool int", "reverse-whole")

    def near(self, settled: DataFrame) -> DataFrame:
        """(query_id, id, pool): of the first documents with any token those that share enough, without the settled (query_id, pool)."""
        return stored_parts(self.spark, self._picked(False, settled), f"query_id {self.query_type}, id {self.id_type}, pool int", "reverse-near")
