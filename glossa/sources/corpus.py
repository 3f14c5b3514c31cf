"""Sources and sinks: source entries, documents as JSON lines, articles, media archives, manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators.nested import parse

#: Fields of a search document's JSON line.
DOCUMENT = (
    "dictionaryId string, entryId string, scope string, headword string, headwordForms array<string>, englishLookupTerms array<struct<kind:string,text:string>>, englishText string, candidateText string, "
    "definitionText string, chineseText string, semanticRole string, origin string, resourceCategory string, location struct<section:string,part:string,ownerId:string,path:array<string>>, weight int"
)
LINE_LIMIT, PREVIEW, PARTS, PART = 1 << 20, 120, 8, 32
# Fields of a source entry that hold projected text, in order.
TEXT_KEYS = ("eng", "simp", "text", "word", "name", "def_eng", "def_simp")


def source_entries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete entries, others) of source rows (id, word, word_body JSON): a row counts if it has an id, a word and readable JSON."""
    readable = F.try_parse_json("word_body").isNotNull()
    good = F.coalesce((F.col("id") != "") & (F.trim("word") != "") & readable, F.lit(False))
    return df.filter(good), df.filter(~good)


def projected_text(value) -> str:
    """Text of a node: its `value`, else its text fields one after another."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(map(projected_text, value))
    if isinstance(value, dict):
        return projected_text(value["value"]) if "value" in value else "".join(projected_text(value[k]) for k in TEXT_KEYS if k in value)
    return ""


def projection(body: str) -> tuple[list[str], str]:
    """(parts of speech, first Chinese definition) of a source entry in document order, bounded in number and length."""
    try:
        root = parse(body)
    except ValueError:
        return [], ""
    parts: list[str] = []
    preview, stack = "", [("", root)]
    while stack:
        key, node = stack.pop()
        if key == "pos":
            for item in node if isinstance(node, list) else [node]:
                part = projected_text(item).strip()
                if part and len(part) <= PART and part not in parts and len(parts) < PARTS:
                    parts.append(part)
        elif key == "def_simp" and not preview:
            text = projected_text(node).strip()
            if any("一" <= c <= "鿿" or "㐀" <= c <= "䶿" for c in text):
                preview = text[:PREVIEW]
        if isinstance(node, dict):
            stack.extend(reversed(list(node.items())))
        elif isinstance(node, list):
            stack.extend(("", x) for x in reversed(node))
    return parts, preview


def projected_entries(df: DataFrame) -> DataFrame:
    """(id, word, parts_of_speech, translation_preview) of source rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [projection(b) for b in pdf["word_body"]]
            yield pd.DataFrame({"id": pdf["id"], "word": pdf["word"], "parts_of_speech": [p for p, _ in made], "translation_preview": [t for _, t in made]})

    return df.select("id", "word", "word_body").mapInPandas(run, "id string, word string, parts_of_speech array<string>, translation_preview string")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, refused lines) of JSON lines: a line is refused if it is too long, is no object, or has a field that is not known."""
    known = F.array(*(F.lit(f.split(" ")[0].strip()) for f in DOCUMENT_FIELDS))
    lines = spark.read.text(path)
    keys = F.json_object_keys("value")
    good = F.coalesce((F.octet_length("value") <= LINE_LIMIT) & (F.size(F.array_except(keys, known)) == 0), F.lit(False))
    return lines.filter(good).select(F.from_json("value", DOCUMENT).alias("d")).select("d.*"), lines.filter(~good)


DOCUMENT_FIELDS = ("dictionaryId", "entryId", "scope", "headword", "headwordForms", "englishLookupTerms", "englishText", "candidateText", "definitionText", "chineseText", "semanticRole", "origin", "resourceCategory", "location", "weight")


def write_documents(df: DataFrame, path: str) -> None:
    """Documents as JSON lines in the order of their entries, each file sorted and the files in order."""
    df.repartitionByRange("entryId").sortWithinPartitions("entryId").write.mode("overwrite").json(path)


def unsorted(df: DataFrame, key: str, position: str, by: list[str]) -> DataFrame:
    """Rows that come after one with a greater key within their part."""
    return df.withColumn("_before", F.max(key).over(Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("_before") > F.col(key)).drop("_before")


def article_rows(index: DataFrame, articles: DataFrame) -> DataFrame:
    """(term, article_id, position, payload) of terms with JSON arrays of ids, and articles that no term names under their own word."""
    named = index.select(X.straight_apostrophes(F.col("word")).alias("term"), F.posexplode(F.from_json("word_ids", "array<string>")).alias("position", "article_id"))
    joined = named.join(articles.select(F.col("id").cast("string").alias("article_id"), "payload"), "article_id")
    lone = articles.select(F.col("id").cast("string").alias("article_id"), X.straight_apostrophes(F.col("word")).alias("term"), "payload").join(named.select("article_id"), "article_id", "left_anti")
    return joined.select("term", "article_id", "position", "payload").unionByName(lone.select("term", "article_id", F.lit(0).alias("position"), "payload"))


def article_faults(index: DataFrame, articles: DataFrame) -> DataFrame:
    """(fault, article_id): ids that no article has, and ids that several terms name."""
    named = index.select("word", F.explode(F.from_json("word_ids", "array<string>")).alias("article_id"))
    missing = named.join(articles.select(F.col("id").cast("string").alias("article_id")), "article_id", "left_anti").select(F.lit("missing").alias("fault"), "article_id").distinct()
    shared = named.groupBy("article_id").agg(F.countDistinct("word").alias("n")).filter("n > 1").select(F.lit("shared").alias("fault"), "article_id")
    return missing.unionByName(shared)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, key, member) of ZIP archives: lower-case base name without extension, names that come twice in an archive left out."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [i.filename for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/")]
                yield pd.DataFrame({"archive": name, "key": [f.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower() for f in found], "member": found})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, key string, member string")
    return rows.groupBy("archive", "key").agg(F.count("*").alias("n"), F.first("member").alias("member")).filter("n = 1").drop("n")


def manifest_faults(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(name, fault) of files that are missing or differ from a manifest (name, bytes, sha256)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    fault = F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_sha") != F.col("sha256"), "digest")
    return manifest.join(there, "name", "left").select("name", fault.alias("fault")).filter("fault is not null")


def intact(df: DataFrame, payload: str, size: str, digest: str) -> DataFrame:
    """Rows whose payload has the size and digest stored with it."""
    p = F.col(payload).cast("binary")
    return df.filter((F.octet_length(p) == F.col(size)) & (F.sha2(p, 256) == F.col(digest)))
