"""Article markup as blocks of runs, and plain previews of it."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.StructType([T.StructField("text", T.StringType()), T.StructField("marks", T.ArrayType(T.StringType())), T.StructField("href", T.StringType())])
BLOCK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("runs", T.ArrayType(RUN))])
# Elements that are understood, and the mark or block that each stands for.
BLOCKS = {"p": "paragraph", "blockquote": "quote"}
MARKS = {"strong": "strong", "b": "strong", "span": "foreign", "em": "foreign", "i": "foreign"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.open: list[tuple[str, str | None, str | None]] = []  # element, mark, href
        self.unknown = False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.blocks.append({"kind": BLOCKS[tag], "runs": []})
        elif tag == "a":
            self.open.append((tag, None, dict(attrs).get("href")))
        elif tag in MARKS:
            self.open.append((tag, MARKS[tag], None))
        elif tag != "br":
            self.unknown = True

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                break

    def handle_data(self, data):
        if not data.strip() and not (self.blocks and self.blocks[-1]["runs"]):
            return
        if not self.blocks:
            self.blocks.append({"kind": "paragraph", "runs": []})
        marks = list(dict.fromkeys(m for _, m, _ in self.open if m))
        href = next((h for _, _, h in reversed(self.open) if h), None)
        self.blocks[-1]["runs"].append({"text": data, "marks": marks, "href": href})


def blocks_of(markup: str, strict: bool = True) -> list[dict] | None:
    """Blocks of an article; None where strict and an element is not understood. Comments are left out."""
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    return None if strict and reader.unknown else reader.blocks


@F.pandas_udf(T.ArrayType(BLOCK))
def parsed_blocks(values: pd.Series) -> pd.Series:
    """blocks_of() as a column; null for null and for markup that is not understood."""
    return values.map(blocks_of, na_action="ignore")


def plain_text(blocks):
    """Text of parsed blocks, a space between blocks."""
    return F.array_join(F.transform(blocks, lambda b: F.array_join(F.transform(b["runs"], lambda r: r["text"]), "")), " ")
