"""Problem 1: evaluation queries that occur in the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.overlap import Rule, cross_classes, cross_pairs
from glossa.session import table

# Set phrases that only frame a question, without punctuation; the problem says that they don't count.
FRAMES_BEFORE = (
    "how do you say", "how do i say", "how would you say", "how to say", "what is it called when", "what do you call it when", "what do you call",
    "what is the word for", "what is a word for", "whats the word for", "is there a word for", "is there a word that means", "i am looking for a word for",
    "looking for a word for", "i am looking for", "im looking for", "looking for", "a word for this", "a word for", "the word for", "another word for", "word for this",
    "please tell me", "can you tell me", "could you tell me", "tell me",
    "有没有词表示", "有没有一个词表示", "有什么词表示", "哪个词表示", "什么词表示", "怎么形容", "如何形容", "怎样形容", "如何表达", "怎么表达", "怎样表达", "怎么说", "请问",
)
FRAMES_AFTER = ("in english", "please", "的说法", "英文怎么讲", "英语怎么讲", "英文怎么说", "英语怎么说", "用英文怎么说", "用英语怎么说", "怎么说", "怎么讲", "怎么表达", "的英文", "的英语", "的词")

#: One word exchanged or left out, whatever the length, and the question's frame left out of account.
RULE = Rule(loss=1, overlap=1.0, before=FRAMES_BEFORE, after=FRAMES_AFTER)


def _side():
    """Side of a case by its split; made when a query runs, for a column needs a session."""
    return F.when(F.col("split") == "training", "train").when(F.col("split").isin("development", "holdout"), "eval")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cross_pairs(table(spark, sf, "threshold_cases"), "id", _side(), "query", RULE)
    return pairs.filter("eval_key <> train_key").select(F.least("eval_key", "train_key").alias("id_a"), F.greatest("eval_key", "train_key").alias("id_b")).distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs, evaluation cases and training cases by evaluation split and by the source of the training case.

    Counted by classes of equal texts, so copies are never written out as pairs.
    """
    cases = table(spark, sf, "threshold_cases")
    links, members = cross_classes(cases, "id", _side(), "query", RULE)
    rows = lambda side, word, field: members.filter(F.col("side") == side).join(cases.filter(_side() == side).select("id", field).distinct(), "id").select(F.col("words").alias(word), field, "id").distinct()
    ev, tr = rows("eval", "we", "split"), rows("train", "wt", "source")
    by_ev, by_tr = ev.groupBy("we", "split").agg(F.count("*").alias("ne")), tr.groupBy("wt", "source").agg(F.count("*").alias("nt"))
    both = links.join(by_ev, "we").join(by_tr, "wt")
    pairs = both.groupBy("split", "source").agg(F.sum(F.col("ne") * F.col("nt")).alias("pairs"))
    of_ev = both.select("we", "split", "source").distinct().join(ev, ["we", "split"]).groupBy("split", "source").agg(F.countDistinct("id").alias("eval_cases"))
    # null is a source too, so the joins on it are null-safe
    of_tr = both.select("wt", "split", F.col("source").alias("_source")).distinct().join(tr, "wt").filter(F.col("source").eqNullSafe(F.col("_source"))).groupBy("split", "source").agg(F.countDistinct("id").alias("train_cases"))
    same = lambda df: df.withColumnsRenamed({"split": "_split", "source": "_from"})
    on = F.col("split").eqNullSafe(F.col("_split")) & F.col("source").eqNullSafe(F.col("_from"))
    return pairs.join(same(of_ev), on).drop("_split", "_from").join(same(of_tr), on).select("split", "source", "pairs", "eval_cases", "train_cases")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLE: dict[str, str] = {}
