"""The k most similar vectors of every vector: balanced posting lists with an in-memory graph over their centroids.

1. Equal vectors are searched once; each keeps its k + 1 smallest ids.
2. Centroids are fitted on a bounded sample by balanced splitting, and linked to a graph that each
   task searches by beam; every vector is indexed, none is left out.
3. A vector enters the lists of its nearest centroids, as many as lie within a ratio of the nearest one's
   distance (copies for boundary vectors), and a query visits lists by a ratio of its own.
4. Lists are scored as blocks of at most BLOCK rows on either side, however large a list is, and the best
   k of a vector over its lists are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut, stored

#: Bound of the sample that centroids are fitted on, sampled rows that a list has at least, and the most lists; beyond, lists grow and are scored in more blocks.
SAMPLE, SAMPLED, MOST_LISTS = 400_000, 8, 65_536
#: Rows to a list before copies; rows on one side of a scored block.
LIST, BLOCK = 150, 4_000
LINKS, BEAM, ENTRIES = 20, 30, 5
#: Centroids that a scan compares at a time.
CELLS = 1 << 24


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """About `lists` unit centroids: the sample is split in up to 16 parts, again and again, until no part is larger than its share."""
    rng = np.random.default_rng(seed)
    share = max(1, len(sample) // max(1, lists))
    open_, done = [sample], []
    while open_:
        part = open_.pop()
        if len(part) <= share:
            done.append(part.mean(axis=0))
            continue
        ways = int(min(16, max(2, round(len(part) / share))))
        heads = part[rng.choice(len(part), ways, replace=False)]
        for _ in range(4):
            own = np.argmax(part @ heads.T, axis=1)
            for w in range(ways):
                if (own == w).any():
                    heads[w] = part[own == w].mean(axis=0)
            heads = unit(heads)
        own = np.argmax(part @ heads.T, axis=1)
        pieces = [p for w in range(ways) if len(p := part[own == w])]
        open_.extend(pieces if len(pieces) > 1 else np.array_split(part, ways))
    return unit(np.stack(done))


class Graph:
    """Nearest-neighbour graph over the centroids, with a coarse layer to enter it."""

    def __init__(self, heads: np.ndarray):
        self.heads = heads
        n = len(heads)
        links = min(LINKS, n - 1)
        self.links = np.zeros((n, max(1, links)), dtype=np.int32)
        for a in range(0, n, 1024):
            sim = heads[a : a + 1024] @ heads.T
            sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
            if links:
                self.links[a : a + 1024] = np.argpartition(-sim, links - 1, axis=1)[:, :links]
        rng = np.random.default_rng(11)
        self.doors = rng.choice(n, min(n, max(ENTRIES, int(4 * np.sqrt(n)), n // 6)), replace=False).astype(np.int32)

    def nearest(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, similarity) of up to `most` near centroids of each unit vector, best first."""
        n = len(self.heads)
        beam = max(BEAM, most)
        steps = 4 + beam // ENTRIES
        if steps * ENTRIES * LINKS >= n:  # a walk would compare no fewer centroids than there are: all of them are compared, which is exact
            most, rows = min(most, n), max(1, CELLS // n)
            if len(x) > rows:
                parts = [self.nearest(x[a : a + rows], most) for a in range(0, len(x), rows)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            sim = x @ self.heads.T
            best = np.argpartition(-sim, most - 1, axis=1)[:, :most] if most < n else np.tile(np.arange(n), (len(x), 1))
            s = np.take_along_axis(sim, best, 1)
            order = np.argsort(-s, axis=1)
            return np.take_along_axis(best, order, 1), np.take_along_axis(s, order, 1)
        sim = x @ self.heads[self.doors].T
        first = np.argpartition(-sim, ENTRIES - 1, axis=1)[:, :ENTRIES]
        ids, s = self.doors[first], np.take_along_axis(sim, first, 1)
        expanded = np.zeros(ids.shape, dtype=bool)
        for _ in range(steps):
            waiting = np.where(expanded, -3.0, s)
            width = min(ENTRIES, waiting.shape[1])
            pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
            if (np.take_along_axis(waiting, pick, 1) < -2).all():
                break
            np.put_along_axis(expanded, pick, True, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)].reshape(len(x), -1)
            new_s = np.einsum("bkd,bd->bk", self.heads[new], x, optimize=True)
            ids, s = np.concatenate([ids, new], 1), np.concatenate([s, new_s], 1)
            expanded = np.concatenate([expanded, np.zeros(new.shape, dtype=bool)], 1)
            order = np.argsort(ids * 2 + ~expanded, axis=1)  # a copy that is expanded comes first and stays
            ids, s, expanded = (np.take_along_axis(v, order, 1) for v in (ids, s, expanded))
            s[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2.5
            keep = np.argpartition(-s, beam - 1, axis=1)[:, :beam] if s.shape[1] > beam else np.argsort(-s, axis=1)
            ids, s, expanded = (np.take_along_axis(v, keep, 1) for v in (ids, s, expanded))
            expanded |= s < -2
        order = np.argsort(-s, axis=1)[:, :most]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)

    def lists(self, x: np.ndarray, most: int, ratio: float, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list whose centroid lies within `ratio` of the nearest one's distance, at least `least` and at most `most` a row."""
        found, s = self.nearest(x, most)
        d = np.sqrt(np.maximum(0, 2 - 2 * s))
        near = ((d <= ratio * np.maximum(d[:, :1], 1e-3)) | (np.arange(d.shape[1]) < least)) & (s > -2)
        row, place = np.nonzero(near)
        return row, found[row, place]


def blocks_to_vectors(blocks: DataFrame, first: str, count: str, data: str, width: int) -> DataFrame:
    """(id, v) of the vectors in blocks of signed bytes; blocks with null fields or of the wrong length give none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, n, d in zip(pdf["f"], pdf["n"], pdf["d"]):
                if len(d) == n * width:
                    yield pd.DataFrame({"id": np.arange(f, f + n), "v": [d[i * width : (i + 1) * width] for i in range(n)]})

    whole = blocks.select(F.col(first).cast("long").alias("f"), F.col(count).alias("n"), F.col(data).alias("d")).dropna()
    return whole.mapInPandas(cut, "id long, v binary")


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.int8).reshape(len(values), -1)


def neighbours(vectors: DataFrame, k: int = 5, least: float = -1.0, queries=None, copies: tuple[int, float] = (6, 1.25), visits: tuple[int, float] = (6, 1.25), list_rows: int = LIST, share: float = 0.0) -> DataFrame:
    """(id, neighbour, cosine): up to k most similar other vectors of every query, none below `least`, ties to the smaller id.

    vectors: (id long, v binary of signed bytes, all of one width). queries: condition on id; default all.
    copies, visits: most lists and distance ratio for a vector and for a query; share: a query visits at least this
    share of all lists, however distant, so that what it finds doesn't fall with their number. Null ids or vectors and zero
    vectors take no part; a repeated id counts once, with the smallest of its vectors; an empty table gives no rows. Similarity is exact,
    the choice of lists is not: a neighbour in none of a query's lists is missed.
    """
    spark = vectors.sparkSession
    clean = vectors.select("id", "v").filter("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v")).filter(F.regexp_replace(F.hex("v"), "0", "") != "")
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    front = clean.withColumn("r", place).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    front = stored(front.withColumn("rep", F.col("ids")[0]), "knn-distinct")
    asked = clean.filter(queries) if queries is not None else clean
    total = front.count()
    if not total:
        return spark.createDataFrame([], "id long, neighbour long, cosine double")
    wanted = front if queries is None else front.join(asked.select("v").distinct(), "v", "left_semi")

    rate = min(1.0, SAMPLE / total)
    taken = front.select("v").sample(rate, 5) if rate < 1 else front.select("v")
    sample = unit(_matrix([r.v for r in taken.limit(SAMPLE).collect()] or [front.first().v]))
    heads = centroids(sample, max(1, min(MOST_LISTS, total // list_rows, len(sample) // (SAMPLED if rate < 1 else 1))))
    wide = math.ceil(share * len(heads))
    graph = spark.sparkContext.broadcast(Graph(heads))

    def assign(role: int, most: int, ratio: float, least: int = 0):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 2048):
                    part = pdf.iloc[a : a + 2048]
                    row, at = graph.value.lists(unit(_matrix(part["v"].tolist())), most, ratio, least)
                    yield pd.DataFrame({"list": at.astype(np.int32), "role": np.int8(role), "rep": part["rep"].to_numpy()[row], "v": part["v"].to_numpy()[row]})

        return run

    schema = "list int, role byte, rep long, v binary"
    if queries is None and copies == visits and not wide:
        postings = front.select("rep", "v").mapInPandas(assign(3, *copies), schema)
    else:
        postings = front.select("rep", "v").mapInPandas(assign(1, *copies), schema).unionByName(wanted.select("rep", "v").mapInPandas(assign(2, max(visits[0], wide), visits[1], wide), schema))
    postings = stored(postings, "knn-lists")

    # a list of more than BLOCK rows on a side is scored as a grid of blocks; the grids are a table of at most MOST_LISTS rows
    sizes = postings.groupBy("list").agg(F.sum(F.col("role").bitwiseAND(1)).alias("i"), F.sum(F.shiftright(F.col("role").bitwiseAND(2), 1)).alias("q"))
    grids = cut(sizes.select("list", F.ceil(F.col("i") / BLOCK).cast("int").alias("gi"), F.ceil(F.col("q") / BLOCK).cast("int").alias("gq")).filter("gi > 1 or gq > 1"))
    if not grids.isEmpty():
        postings = postings.join(F.broadcast(grids), "list", "left")
        gi, gq = F.greatest(F.col("gi"), F.lit(1)), F.greatest(F.col("gq"), F.lit(1))
        own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
        cells = lambda rows, cols, role: F.transform(rows, lambda r: F.struct(r.alias("bi"), cols.alias("bq"), F.lit(role).cast("byte").alias("role")))
        as_item = F.transform(F.sequence(F.lit(0), gq - 1), lambda c: F.struct(own(gi).alias("bi"), c.cast("int").alias("bq"), F.lit(1).cast("byte").alias("role")))
        as_query = F.transform(F.sequence(F.lit(0), gi - 1), lambda c: F.struct(c.cast("int").alias("bi"), own(gq).alias("bq"), F.lit(2).cast("byte").alias("role")))
        none = F.array().cast("array<struct<bi:int,bq:int,role:tinyint>>")
        both = F.concat(F.when(F.col("role").bitwiseAND(1) > 0, as_item).otherwise(none), F.when(F.col("role").bitwiseAND(2) > 0, as_query).otherwise(none))
        single = F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bq"), F.col("role")))
        cell = F.when(F.col("gi").isNull(), single).otherwise(both)
        postings = postings.select("list", "rep", "v", F.inline(cell))
    else:
        postings = postings.withColumns({"bi": F.lit(0), "bq": F.lit(0)})

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        role = pdf["role"].to_numpy()
        items, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        rep = pdf["rep"].to_numpy()
        out = []
        if items.size and asks.size:
            x = _matrix(pdf["v"].tolist()).astype(np.float32)
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            right = x[items].T.copy()
            for a in range(0, asks.size, 512):
                q = asks[a : a + 512]
                s = (x[q] @ right).astype(np.float64) / norm[q][:, None] / norm[items][None, :]
                s[rep[q][:, None] == rep[items][None, :]] = -2
                top = min(k, items.size)
                best = np.argpartition(-s, top - 1, axis=1)[:, :top]
                sim = np.take_along_axis(s, best, 1)
                r, c = np.nonzero((sim >= least) & (sim > -1.5))
                out.append(pd.DataFrame({"rep": rep[q][r], "near": rep[items][best[r, c]], "cosine": sim[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": rep[:0], "near": rep[:0], "cosine": np.zeros(0)})

    pairs = postings.groupBy("list", "bi", "bq").applyInPandas(score, "rep long, near long, cosine double")
    # of equal vectors only the k + 1 smallest ids can be neighbours of another
    near = pairs.dropDuplicates(["rep", "near"]).join(front.select(F.col("rep").alias("near"), F.slice("ids", 1, k).alias("ids")), "near")
    top = near.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "near", "ids"))), 1, k).alias("found"))
    members = asked.join(front, "v").join(top, "rep", "left")
    own = F.transform(F.filter("ids", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(-1.0).alias("far"), x.alias("neighbour")))
    other = F.flatten(F.transform(F.coalesce("found", F.array()), lambda f: F.transform(f["ids"], lambda x: F.struct(f["far"].alias("far"), x.alias("neighbour")))))
    best = F.slice(F.array_sort(F.concat(own, other)), 1, k)
    rows = members.select("id", F.inline(best))
    return rows.select("id", "neighbour", F.abs("far").alias("cosine") if least >= 0 else (-F.col("far")).alias("cosine"))
