"""Benchmark decontamination by winnowing, in Catalyst expressions alone.

Texts are words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is 10 consecutive words of an item, or all words of an
item of fewer. The window of L words has a fingerprint: the least hash among its k-grams, k being half of L rounded up, so a
span of L words that a document shares with an item has the same fingerprint in both: none is missed, whatever stands around
it. 
Fingerprints of documents and items are joined, and hits are extended: every window whose fingerprint an item has is compared word for
word with the items' windows. Words inside any window that stands in an item are hit.

Fingerprints and windows of the benchmark are broadcast up to counted bounds. Beyond them records of documents, not texts, are joined with salt,
and only documents with a hit are read again: the rows are the same.

Defined results: null text has no words, an item without words has no window; rows of one item_id are one item, and a null one is
an item of the name `null`; repeated rows are answered each; an empty benchmark leaves all documents clean; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, looked_up, names_free, stored, table

WINDOW = 10
#: What stands between words, before lower-casing.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints (one long each) are broadcast up to so many.
MOST_FINGERPRINTS = 1_000_000


def split_words(text: Column) -> Column:
    """Split at the rest, which takes a quarter of the time that extracting the matches of the words' negated class does."""
    return F.array_remove(F.split(text, GAP), "")


def words_of(text: Column) -> Column:
    return split_words(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def gram_size(length: int) -> int:
    return (length + 1) // 2


def fingerprint(hashes: Column, at: Column, length: int) -> Column:
    """The least hash among the k-grams of the window of so many words from a place on; null where the text ends before."""
    k = gram_size(length)
    grams = [F.xxhash64(F.lit(k), *[F.get(hashes, at + (i + j)) for j in range(k)]) for i in range(length - k + 1)]
    return F.when(at + length <= F.size(hashes), F.least(*grams) if len(grams) > 1 else grams[0])


def opened(rows: DataFrame, length: int) -> DataFrame:
    """A row for each window of the rows' texts, with words, hashes, at and fp. Fingerprints are taken row by row, in compiled code; the outer
    form of the explosion is there as for the inner one Spark would compute the hashes twice, for a filter by their number."""
    rows = rows.withColumn("words", words_of(F.col("text"))).drop("text")
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.select("*", F.posexplode_outer("hashes").alias("at", "_own")).drop("_own")
    return rows.withColumn("fp", fingerprint(F.col("hashes"), F.col("at"), length)).filter("fp is not null")


def window_at(length: int) -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, F.lit(length)), " ")


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables: (window, wid, length, fp) of the distinct windows, and (of_wid, item) of those in which they stand."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(rows.withColumn("length", F.least(F.size(words_of(F.col("text"))), F.lit(WINDOW))))
    spans = None
    for length in _lengths(rows):
        part = opened(rows.filter(F.col("length") == length), length).select("item", "length", "fp", window_at(length).alias("window"))
        spans = part if spans is None else spans.unionByName(part)
    if spans is None:
        spans = rows.select("item", "length", F.lit(0).cast("long").alias("fp"), F.lit("").alias("window")).filter(F.lit(False))
    spans = stored(spans.distinct())
    windows = stored(spans.select("window", "length", "fp").distinct().withColumn("wid", F.monotonically_increasing_id()))
    found = looked_up(spans.select("item", "window"), windows.select("window", "wid"), ["window"], F.col("item"))
    return windows, stored(found.select(F.col("wid").alias("of_wid"), "item"))


def _lengths(rows: DataFrame) -> list[int]:
    """The lengths of windows that there are: ten at most."""
    return sorted(r["length"] for r in rows.filter("length > 0").select("length").distinct().collect())


def _met(rows: DataFrame, prints: DataFrame, length: int, most: int) -> DataFrame:
    """id, text_key, at and window of the windows whose fingerprint an item has."""
    wanted = ("id", "text_key", "at")
    every = opened(rows, length)
    if prints.count() <= most:
        every = every.join(F.broadcast(prints.withColumnRenamed("fp", "_fp")), F.col("fp") == F.col("_fp"), "left_semi")
    else:
        # Windows with the fingerprint of the one before are one record. Records without texts are shuffled; texts only of rows that have met something.
        before = fingerprint(F.col("hashes"), F.col("at") - 1, length)
        records = every.filter((F.col("at") == 0) | (before != F.col("fp"))).select("id", "text_key", "at", "fp")
        some = looked_up(records, prints, ["fp"], F.col("at"), few=0).select("id", "text_key", "fp").distinct()
        some = stored(some.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("fp").alias("_fp")))
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
        again = rows.join(some.select("_id", "_key").distinct().hint("merge"), same, "left_semi")
        # The windows themselves are shuffled, never a row with all words of its text.
        every = opened(again, length).select(*wanted, "fp", window_at(length).alias("window"))
        return every.join(some.hint("merge"), same & (F.col("fp") == F.col("_fp")), "left_semi").select(*wanted, "window")
    return every.select(*wanted, window_at(length).alias("window"))


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_FINGERPRINTS) -> DataFrame:
    """id, text_key, at (0-based place of a word), length, wid: the windows of items in the documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = None
    for length in _lengths(windows):
        prints = stored(windows.filter(F.col("length") == length).select("fp").distinct())
        part = _met(rows, prints, length, most).withColumn("length", F.lit(length))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("id", "text_key", F.lit(0).alias("at"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("wid")).filter(F.lit(False))
    return looked_up(found, windows.select("window", "wid"), ["window"], F.col("at")).select("id", "text_key", "at", "length", "wid")


def covered(spans: Column) -> Column:
    """How many places the (at, length) of an array cover."""
    end = lambda x: x["at"] + x["length"]
    step = lambda acc, x: F.struct(F.greatest(acc["end"], end(x)).alias("end"), (acc["n"] + F.greatest(F.lit(0), end(x) - F.greatest(x["at"], acc["end"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = MOST_FINGERPRINTS) -> DataFrame:
    """Per row: id, text_key, n_words, n_hit, items (names of the items with windows in it, sorted; null without any)."""
    names_free(docs, id_col, text_col)
    names_free(benchmark, item_col, item_text)
    windows, members = item_windows(benchmark, item_col, item_text)
    found = hits(docs, windows, id_col, text_col, most)
    key = ["id", "text_key"]
    # Of rows that agree in id and text the windows are counted once; a row's lists are bounded by its own words.
    per = stored(found.groupBy(*key).agg(F.collect_set(F.struct("at", "length")).alias("spans"), F.collect_set("wid").alias("wids")))
    items = per.select(*key, F.explode("wids").alias("wid")).join(members.hint("merge"), F.col("wid") == F.col("of_wid"))
    items = items.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    own = {c: F.col(c).alias(f"_{c}") for c in key}
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text_key"))
    both = per.select(*key, covered(F.col("spans")).alias("n_hit")).join(items.select(*own.values(), "items"), same).drop("_id", "_text_key")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.size(split_words(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("n_words"))
    both = stored(both.select(*own.values(), "n_hit", "items"))
    out = rows.join(both, same, "left").drop("_id", "_text_key")
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))


def clean_of(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_hit: float = 0.0) -> DataFrame:
    """The documents, with all their columns, of whose words at most the given share is hit."""
    key, of_id, of_key = fresh(docs, "_key", "_of_id", "_of_key")
    bad = contamination(docs, benchmark, id_col, text_col, item_col, item_text).filter((F.col("n_hit") > 0) & (F.col("n_hit") > most_hit * F.col("n_words")))
    bad = bad.select(F.col("id").alias(of_id), F.col("text_key").alias(of_key))
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.join(bad, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left_anti").drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS tag, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dp AS (SELECT tag, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l
), dw AS (SELECT tag, l, i, array_to_string(w[i:i + l - 1], ' ') AS t FROM dp
), m AS (SELECT dw.tag, dw.l, dw.i, bw.item FROM dw JOIN bw USING (l, t)
), h AS (SELECT tag, count(DISTINCT p) AS n_hit FROM (SELECT tag, unnest(range(i, i + l)) AS p FROM m) GROUP BY tag
), k AS (SELECT tag, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT tag, item FROM m) GROUP BY tag
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (tag) LEFT JOIN k USING (tag)
"""
