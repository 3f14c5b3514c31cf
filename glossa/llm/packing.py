"""Texts put together into containers of fixed capacity with little unused space: vector best-fit.

A container has three capacities: tokens, documents and attention cost (the sum of squared lengths).
Items go in by falling length, each into the open container that satisfies every capacity and whose
residual vector, each part relative to its capacity and weighted, has the least norm afterwards; where there is none a
container is opened. A text is divided only if it alone is longer than a container.

Items are spread by hash and packed in chunks of CHUNK; containers of a chunk that stay under FULL are
opened again, and their items are packed with those of all other chunks in the next round, until the rest fits one chunk or a round
settles less than GAIN of it.
Every row of a task depends on its hash partition in sorted order alone, so a lost task gives the same containers again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import stored

CHUNK, TASK_ITEMS = 8192, 200_000
FULL, GAIN = 0.99, 0.1


@dataclass(frozen=True)
class Capacity:
    """What a container holds. A cost of tokens squared or more never limits: the sum of squares is at most the square of the sum."""

    tokens: int = 1024
    documents: int = 16
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def public_tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(path of the vocabulary file, split pattern) of an installed public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def token_counts(df: DataFrame, key: str, text: str, tokenizer: tuple[str, str]) -> DataFrame:
    """(id, n): tokens of each text with a key; null and empty texts have none and give no row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(*tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "n": [len(encoding.encode_ordinary(t)) for t in pdf["text"]]})

    read = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and length(text) > 0")
    return read.mapInPandas(count, f"id {read.schema['id'].dataType.simpleString()}, n long")


def best_fit(sizes: np.ndarray, cap: Capacity) -> np.ndarray:
    """The container of every item, numbered from 0. Items are at most cap.tokens long; one that exceeds another capacity is alone in its container."""
    own = np.zeros(len(sizes), dtype=np.int64)
    limit = np.array([cap.tokens, cap.documents, cap.cost], dtype=np.float64)
    scale = np.array(cap.weights) / limit**2
    left, name = np.empty((3, 256)), np.empty(256, dtype=np.int64)
    n_open = made = 0
    least = sizes.min() if len(sizes) else 0
    for i in np.argsort(-sizes, kind="stable"):
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        after = left[:, :n_open] - need[:, None]
        fits = (after >= 0).all(axis=0)
        if fits.any():
            norm = np.where(fits, (after * after * scale[:, None]).sum(axis=0), np.inf)
            b = int(norm.argmin())
            left[:, b] = after[:, b]
        else:
            if n_open == name.size:
                left, name = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([name, np.empty_like(name)])
            b, n_open = n_open, n_open + 1
            left[:, b], name[b] = limit - need, made
            made += 1
        own[i] = name[b]
        if left[0, b] < least or left[1, b] < 1:  # nothing fits any more
            n_open -= 1
            left[:, b], name[b] = left[:, n_open], name[n_open]
    return own


def limits(packed: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """(container, tokens, pieces, cost, limit) of packed items: limit names the capacity of which the largest part is used, the first of equal ones."""
    n = F.col("tokens").cast("long")
    by = packed.groupBy("container").agg(F.sum(n).alias("tokens"), F.count("*").alias("pieces"), F.sum(n * n).alias("cost"))
    used = [F.col("tokens") / cap.tokens, F.col("pieces") / cap.documents, F.col("cost") / cap.cost]
    most = F.greatest(*used)
    return by.withColumn("limit", F.when(used[0] == most, "tokens").when(used[1] == most, "documents").otherwise("cost"))


def pack(items: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """(id, piece, first_token, tokens, container) for items (id, n): every token of every item is in one container.

    Items with a null id or without tokens give no row; ids that come twice are two items; an empty table gives no rows.
    """
    whole = F.floor(F.col("n") / cap.tokens).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("n") / cap.tokens).cast("int") - 1),
        lambda p: F.struct(p.alias("piece"), (p.cast("long") * cap.tokens).alias("first_token"), F.when(p < whole, F.lit(cap.tokens)).otherwise(F.col("n") % cap.tokens).cast("int").alias("tokens")),
    )
    rest = stored(items.filter("id is not null and n > 0").select("id", F.inline(pieces)), "pack-items")
    schema = rest.schema.simpleString()[7:-1]
    count, done = rest.count(), None
    turn, before = 0, None
    while True:
        last = count <= CHUNK or (before is not None and count > (1 - GAIN) * before)
        tasks = max(1, -(-count // TASK_ITEMS))

        def run(batches: Iterator[pd.DataFrame], turn=turn, last=last) -> Iterator[pd.DataFrame]:
            first = (turn << 60) + (TaskContext.get().partitionId() << 36)
            waiting: list[pd.DataFrame] = []
            size = 0

            def packed(pdf: pd.DataFrame) -> pd.DataFrame:
                nonlocal first
                own = best_fit(pdf["tokens"].to_numpy(), cap)
                fill = np.bincount(own, weights=pdf["tokens"])
                out = pdf.assign(container=own + first, settled=last | (fill >= FULL * cap.tokens)[own])
                first += int(own.max()) + 1
                return out

            for pdf in batches:
                waiting.append(pdf)
                size += len(pdf)
                if size >= CHUNK:
                    joined = pd.concat(waiting, ignore_index=True)
                    cuts = range(0, len(joined) - len(joined) % CHUNK, CHUNK)
                    yield from (packed(joined.iloc[a : a + CHUNK].reset_index(drop=True)) for a in cuts)
                    waiting, size = [joined.iloc[len(cuts) * CHUNK :]], len(joined) % CHUNK
            if size:
                yield packed(pd.concat(waiting, ignore_index=True))

        spread = rest.repartition(tasks, F.xxhash64("id", "piece")).sortWithinPartitions(F.xxhash64("id", "piece", F.lit(turn)), "id", "piece", "tokens")
        out = stored(spread.mapInPandas(run, f"{schema}, container long, settled boolean"), "pack-round")
        settled = out.filter("settled").drop("settled")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rest = out.filter("not settled").drop("settled", "container")
        before, count, turn = count, rest.count(), turn + 1
        if not count:
            break
    return done
