"""Lexical retrieval: smoothed TF-IDF with cosine scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FUNCTION_WORDS
from tidemark.sources.files import stored

#: What stands between terms, which are two word characters or more, in any script.
GAP = "[^\\p{L}\\p{N}_]+"
#: Words that say nothing about a passage's subject.
STOP_WORDS = tuple(sorted(w for w in FUNCTION_WORDS if len(w) > 1))


def terms(df: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), gap: str = GAP) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.explode(F.split(F.lower(text), gap)).alias("term")).filter(F.length("term") > 1)
    return rows.filter(~F.col("term").isin(*stop)) if stop else rows


def tfidf_top(corpus: DataFrame, questions: DataFrame, k: int = 4, key: str = "chunk_id", text: str = "text", question_key: str = "question_id", stop: tuple[str, ...] = ()) -> DataFrame:
    """The k best passages of each question: question, passage, score and place. idf = ln((1 + n) / (1 + df)) + 1, cosine of tf * idf. The
    corpus is cut into terms once, and counted once; of the weights only the questions' terms are joined to them. Give a list of
    stop words: a term that most passages have brings most passages to a question."""
    counts = stored(terms(corpus, key, text, stop).groupBy("key", "term").agg(F.count("*").cast("double").alias("tf")))
    total = corpus.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(total)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # one row
    asked = terms(questions, question_key, text, stop).groupBy("key", "term").agg(F.count("*").cast("double").alias("tf"))
    asked = asked.join(idf, "term").select(F.col("key").alias(question_key), "term", "idf", (F.col("tf") * F.col("idf")).alias("qw"))
    norm = lambda w: F.sqrt(F.sum(w * w))
    asked = asked.join(asked.groupBy(F.col(question_key).alias("_q")).agg(norm(F.col("qw")).alias("qn")), F.col(question_key) == F.col("_q"))
    # Written, so that Spark knows how large the questions are: a few are broadcast, many are shuffled.
    asked = stored(asked.select(question_key, "term", "idf", (F.col("qw") / F.col("qn")).alias("qw")))
    weighed = counts.join(idf, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighed.groupBy("key").agg(norm(F.col("w")).alias("norm"))
    # The questions' terms bring their idf with them, so all counts meet all of the vocabulary only once, for the norms.
    hit = counts.join(asked, "term").groupBy(question_key, "key").agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot"))
    scores = hit.join(norms, "key").select(question_key, F.col("key").alias(key), (F.col("dot") / F.col("norm")).alias("score")).filter("score > 0")
    w = Window.partitionBy(question_key).orderBy(F.desc(F.round("score", 9)), key)
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def audit_sentences(log: DataFrame) -> DataFrame:
    """Audit entries as passages."""
    d = F.transform(F.map_entries(F.from_json("details", "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    details = F.when(F.size(d) > 0, F.array_join(d, ", ")).otherwise(F.lit("none"))
    who = F.coalesce("user_pseudonym", F.lit("no user (system-level event)"))
    text = F.concat(F.lit("Audit log entry at "), "timestamp", F.lit(": event '"), "event_type", F.lit("' recorded by actor '"), "actor", F.lit("' for "), who, F.lit(". Details: "), details, F.lit("."))
    return log.select(F.lit("audit_log").alias("source"), text.alias("text"))


def corpus(documents: DataFrame, log: DataFrame | None = None, last: int = 50) -> DataFrame:
    """Passages of documents (source, chunk) and of the newest audit entries, with ids."""
    rows = documents.select("source", F.col("chunk").alias("text"))
    if log is not None:
        rows = rows.unionByName(audit_sentences(log.orderBy(F.desc("seq")).limit(last)))
    return rows.withColumn("chunk_id", F.xxhash64("source", "text"))


def answer(question: str, passages: DataFrame, k: int = 4, generator: Callable[[str, list[dict]], str | None] | None = None, stop: tuple[str, ...] = ()) -> dict:
    """Retrieved passages, and an answer by the generator where one is given; else the passages are the answer."""
    asked = passages.sparkSession.createDataFrame([(0, question)], "question_id int, text string")
    found = tfidf_top(passages, asked, k, stop=stop).join(passages, "chunk_id").orderBy("place").select("source", "text", F.round("score", 3).alias("score")).collect()  # k rows
    rows = [r.asDict() for r in found]
    text = generator(question, rows) if generator and rows else None
    return {"question": question, "answer": text or "\n\n".join(r["text"] for r in rows) or "nothing found", "sources": rows, "generated": text is not None}
