"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, tokens). Each text's normalised content (all six ASCII
white-space characters as spaces, which the tokenizer treats alike) is digested in one pass over the texts; digests joined to the
cache have their counts, only the distinct misses are encoded, one text for each, and those that are still missing are appended for
later batches. Several writers, or a run that is repeated, may leave an entry twice: a reader takes one row of each digest.
The hot digest of many copies is one row in all of this but the last join, which adaptive execution splits.

The tokenizer drops white space and never joins across it, so the count of a text is the sum over its words. A
worker splits a batch of texts into words and names the distinct ones in Arrow, keeps the counts of words that it has met
more than once (bounded by `WORDS`), and encodes only new ones.

Defined results: null text is empty and has 0 tokens; repeated rows are encoded once (rows that agree in id and text meet in a task, which
encodes the first of them) and each get the count; a null id is kept; an empty table gives no rows and leaves the cache as it is;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, names_free, row_ranges, shared_dir, stored, strings, table, tokenizer_file
from .exact_dedup import first_arrival

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Words whose counts a worker keeps.
WORDS = 1_000_000
#: Bytes of text whose words are named at once.
CHUNK = 8 << 20
CACHE = "content binary, tokenizer string, n_tokens long"




def tokenizer_digest(name: str) -> str:
    with open(tokenizer_file(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounts:
    """Token counts of texts, by a bounded memory of words. Words met for the first time are counted together, text by text, as most of them
    never come again; a word met again is counted alone and remembered."""

    def __init__(self, name: str, most: int = WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.once, self.most = Tokenizer.from_file(tokenizer_file(name)), {}, set(), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _lengths(self, texts: list[str]) -> np.ndarray:
        return np.array([len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        begin = words.offsets.to_numpy() - words.offsets[0].as_py()
        flat = words.flatten().dictionary_encode()
        at, names = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        n = np.array([self.known.get(w, -1) for w in names], np.int64)
        new = np.flatnonzero(n < 0)
        often = np.bincount(at, minlength=len(names)) > 1
        again = [k for k in new.tolist() if often[k] or names[k] in self.once]
        n[new] = 0
        n[again] = self._lengths([names[k] for k in again])
        for k in again:
            if len(self.known) < self.most:  # the words met first are the frequent ones: once the memory is full, it stays as it is
                self.known[names[k]] = int(n[k])
                self.once.discard(names[k])
        single = np.zeros(len(names), bool)
        single[new] = True
        single[again] = False
        total = np.concatenate(([0], np.cumsum(n[at])))
        found = total[begin[1:]] - total[begin[:-1]]
        # Each of the others stands in one text alone; a text's are encoded as one, a long one's in parts.
        place = np.flatnonzero(single[at])
        if not len(place):
            return found
        row = np.searchsorted(begin, place, "right") - 1
        own = [names[k] for k in at[place].tolist()]
        for w in own[: max(0, self.most - len(self.once))]:
            self.once.add(w)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        cuts = np.concatenate([np.arange(a, b, 4096) for a, b in zip(starts, np.append(starts[1:], len(row)), strict=True)])
        lengths = self._lengths([" ".join(own[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(row)), strict=True)])
        np.add.at(found, row[cuts], lengths)
        return found


def _encoder(name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = WordCounts(name), None
        for batch in batches:
            content = batch.column("content").to_pylist()
            first = np.array([a != b for a, b in zip([last, *content], content, strict=False)], bool)  # rows that agree follow each other
            last = content[-1] if content else last
            rows = batch.filter(pa.array(first))
            text = rows.column("text")
            for a, b in row_ranges(strings(text)[1], CHUNK):
                yield pa.RecordBatch.from_arrays([rows.column("content").slice(a, b - a), pa.array(counts.counts(text.slice(a, b - a)), pa.int64())], names=["content", "n_tokens"])

    return encode


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none where nothing has been written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def known_counts(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One row for each digest of the cache: content and n_tokens."""
    return open_cache(spark, path).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, key (a hash of the text), n_bytes, content (digest of the normalised text); no text leaves the JVM."""
    normal = F.translate("text", SPACE, " " * len(SPACE)).cast("binary")
    return _keyed(docs, id_col, text_col).select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(normal, 256)).alias("content"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def encoded(docs: DataFrame, rows: DataFrame, known: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """content and n_tokens of the digests that are not known; one row stands for each, and its text alone is encoded."""
    one = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "key")).alias("one")
    misses = rows.groupBy("content").agg(one).join(known, "content", "left_anti")
    misses = misses.select(F.col("one.id").alias("of_id"), F.col("one.key").alias("of_key"), "content")
    # A merge join brings rows that agree in id and text together, one after another.
    chosen = _keyed(docs, id_col, text_col).join(misses.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")))
    return chosen.select("content", "text").mapInArrow(_encoder(tokenizer), "content binary, n_tokens long")


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens. Counts that are still missing when they have been made are appended to the cache."""
    names_free(docs, id_col, text_col)
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    rows = cut(digests(docs, id_col, text_col))
    found = encoded(docs, rows, known_counts(spark, cache_path, version), tokenizer, id_col, text_col)
    found = stored(found.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    missing = found.join(known_counts(spark, cache_path, version), "content", "left_anti")
    missing.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # Written, as the cache may have grown when the result is used: Spark takes two reads of one path for the same table, whatever lies there.
    return stored(rows.join(known_counts(spark, cache_path, version), "content").select("id", "n_bytes", "n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two batches, so that the second finds a part of its contents in the cache and adds the rest."""
    docs, cache = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    early = first_arrival("doc_id")
    found = [count_tokens(docs.filter(part), cache) for part in (early, ~early)]
    found = found[0].unionByName(found[1])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
