"""Deeply nested JSON records as flat tables with parent-child links.

Each record is parsed in one pass into (path, ordinals, kind, value) nodes; a path names fields, `[]`
marks a repeated step and `ordinals` holds the place within each of them, counted from 0 as written.
Paths with the same last repeated step form one table, and a pivot of its nodes by (record, ordinals)
makes the rows. The ordinals of a row without its last one are the key of its parent.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{}:,"])|(true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?))')
_WORDS = {"true": True, "false": False, "null": None}


@dataclass(frozen=True)
class Shape:
    """What is known of a record: which fields repeat, and where the document in it begins.

    repeated: paths of list fields, the parent's `[]` included, as in "blocks[].runs". A single value
    that stands there is taken as a list of one, null as an empty list. Lists elsewhere repeat as well.
    anchor: name of the field whose nearest owner (breadth first through objects) is the document; empty: the record itself.
    wanted: path prefixes to keep; empty: all.
    """

    repeated: frozenset[str] = field(default_factory=frozenset)
    anchor: str = ""
    wanted: tuple[str, ...] = ()


def parse(text: str):
    """JSON of any depth as Python values; ValueError if it is not one complete JSON text."""
    text = text.removeprefix("﻿")
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """As json.loads with the open containers on a list of our own, so that depth has no limit."""
    root: list = []
    stack: list[tuple[object, object]] = [(root, None)]
    state, at, key = "value", 0, None
    while True:
        if m := _TOKEN.match(text, at):
            at, sign, word = m.end(), m[1], m[2]
        elif not text[at:].strip(" \t\n\r") and len(stack) == 1 and state == "after":
            return root[0]
        else:
            raise ValueError(f"no JSON at {at}")
        top = stack[-1][0]
        if state in ("key", "first key"):
            if sign == "}" and state == "first key":
                stack.pop()
                state = "after"
            elif sign == '"':
                key, at = scanstring(text, at)
                state = "colon"
            else:
                raise ValueError(f"no key at {at}")
        elif state == "colon":
            if sign != ":":
                raise ValueError(f"no colon at {at}")
            state = "value"
        elif state == "after":
            if sign == "," and len(stack) > 1:
                state = "value" if isinstance(top, list) else "key"
            elif (sign == "]" and isinstance(top, list) or sign == "}" and isinstance(top, dict)) and len(stack) > 1:
                stack.pop()
            else:
                raise ValueError(f"unexpected text at {at}")
        elif sign == "]" and state == "first value":
            stack.pop()
            state = "after"
        else:
            new = None
            if sign == '"':
                value, at = scanstring(text, at)
            elif sign == "{":
                value = new = {}
            elif sign == "[":
                value = new = []
            elif word is not None:
                value = _WORDS[word] if word in _WORDS else json.loads(word)
            else:
                raise ValueError(f"no value at {at}")
            if isinstance(top, list):
                top.append(value)
            else:
                top[key] = value
            state = "after"
            if new is not None:
                stack.append((new, None))
                state = "first key" if sign == "{" else "first value"


def document(text: str, anchor: str):
    """The document within a record's text, or None. A JSON string that holds JSON is opened first."""
    try:
        value = parse(text)
        while isinstance(value, str):
            value = parse(value)
    except ValueError:
        return None
    if not anchor:
        return value
    waiting = deque([value])
    while waiting:
        v = waiting.popleft()
        if isinstance(v, dict):
            if anchor in v:
                return v
            waiting.extend(x for x in v.values() if isinstance(x, dict))
    return None


def nodes(value, shape: Shape) -> Iterator[tuple[str, str, str, str | None]]:
    """(path, ordinals, kind, value) of every node below a document, as a text each."""
    stack = [("", "", value)]
    while stack:
        path, at, v = stack.pop()
        if path in shape.repeated and not path.endswith("[]") and not isinstance(v, list):
            v = [] if v is None else [v]
        if isinstance(v, list):
            stack.extend((f"{path}[]", f"{at},{i}" if at else str(i), x) for i, x in reversed(list(enumerate(v))))
            continue
        if path and (not shape.wanted or path.startswith(shape.wanted)):
            if isinstance(v, str):
                yield path, at, "string", v
            elif isinstance(v, dict):
                yield path, at, "object", None
            elif v is None:
                yield path, at, "null", None
            else:
                yield path, at, "number" if not isinstance(v, bool) else "boolean", json.dumps(v)
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, at, x) for k, x in v.items())


def shred(df: DataFrame, key: str, payload: str, shape: Shape) -> DataFrame:
    """(record, path, ordinals array, kind, value) of all nodes of all readable payloads.

    Rows with a null key, and payloads that are null, empty, unreadable or without the anchor, give no
    nodes. A payload that comes again under its key gives the same nodes again; table() merges them.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for record, text in zip(pdf["record"], pdf["payload"]):
                value = document(text, shape.anchor)
                if value is not None:
                    rows.extend((record, *n) for n in nodes(value, shape))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["record", "path", "at", "kind", "value"])
                    rows = []
            yield pd.DataFrame(rows, columns=["record", "path", "at", "kind", "value"])

    read = df.select(F.col(key).cast("string").alias("record"), F.col(payload).alias("payload")).filter("record is not null and length(payload) > 0")
    flat = read.mapInPandas(walk, "record string, path string, at string, kind string, value string")
    return flat.select("record", "path", F.split("at", ",").cast("array<int>").alias("ordinals"), "kind", "value")


def table(triples: DataFrame, group: str, numbers: list[str], columns: dict[str, str], own: str = "") -> DataFrame:
    """One table: a row for each node of the repeated path `group`.

    numbers: names for the ordinals, outermost first; columns: name -> path below the group's node;
    own: name for the value where a plain value stands in the node's place. Column `kind` is the kind of the
    node itself. Rows are keyed by (record, numbers); a fully merged node leaves each task, so the
    shuffle carries one row per node however wide the table is.
    """
    paths = {c: f"{group}.{p}" for c, p in columns.items()}
    part = triples.filter(F.col("path").isin(group, *paths.values()))
    keyed = part.select("record", *(F.col("ordinals")[i].alias(n) for i, n in enumerate(numbers)), "path", "kind", "value")
    pick = lambda path, what: F.max(F.when(F.col("path") == path, F.col(what)))
    found = [pick(group, "kind").alias("kind"), *(pick(p, "value").alias(c) for c, p in paths.items())]
    if own:
        found.append(pick(group, "value").alias(own))
    return keyed.groupBy("record", *numbers).agg(*found)


def paths_of(triples: DataFrame) -> DataFrame:
    """(path, kind, nodes): the shape of a corpus, to choose tables from."""
    return triples.groupBy("path", "kind").agg(F.count("*").alias("nodes"))
