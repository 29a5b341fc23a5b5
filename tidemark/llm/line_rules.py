"""Quality rules by cross-document line frequency.

Lines are normalised (white space runs to one space, ASCII letters lower-cased, digits to 0) and hashed; for each host
the distinct documents with a line are counted. A line of more documents than the limit (a share of the host's
documents, and a least number) is removed, and a document that thereby loses more than half of its words is
depleted and rejected. Documents are counted by content: the copies of one text are one document, so that copying a
text does not turn its lines into boilerplate. With copies=True every document counts, and a line above `most` documents
goes whatever its share of the host is. Base statistics of the whole text stand beside the verdict.

One scan of the text yields the statistics and, for each distinct line of a row, a hash and the words it holds; all
later steps shuffle only those, pre-aggregated, and join by (host, line) so that a line that is everywhere is split.

Defined results: null text has no words; a null host is a host of its own; repeated rows get the same result; a
text without words fails the base rules; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, counts_by_row, cut, fresh, mix, names_free, powers, prefix_hash, row_ranges, span_hash, strings, table, words_in

#: A line is removed if it stands in more documents of its host than this share of them, and than this number.
SHARE, LEAST = 0.1, 20
MIN_WORDS, MOST_REPEATED = 50, 50
CHUNK = 1 << 20

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCANNED = f"id long, host string, text_key long, content binary, {BASE}, lines array<long>, words array<long>"

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACE]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each (row, hash) occurs, at each entry."""
    _, at, n = np.unique(mix(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    return n[at]


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The base statistics of each row, and row, hash and words of each distinct normalised line."""
    n = len(offsets) - 1
    starts, ends, rows = words_in(data, offsets)
    n_words = counts_by_row(rows, n)
    if not len(starts):
        none = np.zeros(n, np.int64)
        return [n_words, none, _per_row(_SYMBOL[data], offsets), none, none], rows, rows.astype(np.uint64), rows
    chars = _per_row(~_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_row(_SYMBOL[data], offsets)
    raw = prefix_hash(data)
    # Words in repeated 3-word windows.
    word = span_hash(raw, starts, ends)
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        at = np.flatnonzero(rows[2:] == rows[:-2])
        triple = mix(word[at] + mix(word[at + 1] + mix(word[at + 2])))
        again = at[_repeats(rows[at], triple) > 1]
        covered[again] = covered[again + 1] = covered[again + 2] = True
    repeat_words = counts_by_row(rows[covered], n)
    # Lines with a word: the first word of each.
    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.concatenate(([True], (line_of[1:] != line_of[:-1]) | (rows[1:] != rows[:-1]))))
    row, k = rows[first], line_of[first]
    left = np.maximum(offsets[row], np.where(k > 0, breaks[np.maximum(k - 1, 0)] + 1, 0) if len(breaks) else 0)
    right = np.minimum(offsets[row + 1], np.where(k < len(breaks), breaks[np.minimum(k, len(breaks) - 1)], len(data)) if len(breaks) else len(data))
    line = span_hash(raw, left, right)
    key = mix(line ^ mix(row.astype(np.uint64) + np.uint64(1)))
    _, once = np.unique(key, return_index=True)
    dup_lines = counts_by_row(row, n) - counts_by_row(row[once], n)
    # Normalised lines: a hash over the hashes of their words.
    normal = span_hash(prefix_hash(_NORMAL[data]), starts, ends)
    p, inverse = powers(len(normal) + 1)
    sums = np.zeros(len(normal) + 1, np.uint64)
    np.cumsum(normal * p[:-1], out=sums[1:])
    stop = np.append(first[1:], len(starts))
    line = mix((sums[stop] - sums[first]) * inverse[first])
    order = np.lexsort((line, row))
    row, line, words = row[order], line[order], (stop - first)[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (line[1:] != line[:-1]))))
    return [n_words, chars, symbols, dup_lines, repeat_words], row[new], line[new], np.add.reduceat(words, new)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        whole = data.tobytes()
        for a, b in row_ranges(offsets, CHUNK):
            own = offsets[a : b + 1] - offsets[a]
            base, row, line, words = measure(data[offsets[a] : offsets[b]], own)
            at = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            content = [hashlib.blake2b(whole[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in range(a, b)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(a, b - a),
                    batch.column("host").slice(a, b - a),
                    batch.column("text_key").slice(a, b - a),
                    pa.array(content, pa.binary()),
                    *[pa.array(x, pa.int64()) for x in base],
                    pa.ListArray.from_arrays(at, pa.array(line.view(np.int64))),
                    pa.ListArray.from_arrays(at, pa.array(words, pa.int64())),
                ],
                names=["id", "host", "text_key", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "words"],
            )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    names_free(docs, id_col, text_col, host_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(_scan, SCANNED).withColumn("tag", F.monotonically_increasing_id()))


def frequent_lines(scanned: DataFrame, share: float = SHARE, least: int = LEAST, most: int | None = None, copies: bool = False) -> DataFrame:
    """Host, line and number of documents of the lines above the limit: share and least, or most alone."""
    document = ["host", "content", *["id"] * copies]
    lines = scanned.select(*document, F.explode("lines").alias("line")).distinct()
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("docs"))
    hosts = scanned.select(*document).distinct().groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("host_docs"))
    found = counts.filter(F.col("docs") > (least if most is None else min(least, most))).join(hosts, F.col("host").eqNullSafe(F.col("of_host")))
    above = (F.col("docs") > least) & (F.col("docs") > F.col("host_docs") * F.lit(float(share)))
    return found.filter(above if most is None else above | (F.col("docs") > most)).select(F.col("host").alias("of_host"), F.col("line").alias("of_line"), "docs")


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least: int = LEAST, most: int | None = None, copies: bool = False) -> DataFrame:
    """Per row: id, text_key, the base statistics, removed_words, removed (hashes of its removed lines), base_failed, kept."""
    rows = scan(docs, id_col, text_col, host_col)
    frequent = frequent_lines(rows, share, least, most, copies)
    lines = rows.select("tag", "host", F.explode(F.arrays_zip("lines", "words")).alias("x")).select("tag", "host", "x.lines", "x.words")
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("lines") == F.col("of_line")))
    lost = hit.groupBy(F.col("tag").alias("of_tag")).agg(F.sum("words").alias("lost"), F.collect_list("lines").alias("removed"))
    out = rows.join(lost, F.col("tag") == F.col("of_tag"), "left").withColumn("removed_words", F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (2 * F.col("removed_words") <= F.col("n_words")))
    return out.select("id", "text_key", *[x.split()[0] for x in BASE.split(", ")], "removed_words", "removed", "base_failed", "kept")


def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    """The texts without those of their lines whose normalised hash is listed; all lines of a batch are hashed at once."""
    out, gone = [t or "" for t in text], [g is not None and len(g) > 0 for g in removed]
    lines = {i: out[i].split("\n") for i, g in enumerate(gone) if g}
    raw = [x.encode() for parts in lines.values() for x in parts]
    if not raw:
        return pd.Series(out)
    owner = np.repeat(list(lines), [len(parts) for parts in lines.values()])
    _, row, line, _ = measure(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    listed = [np.asarray(removed.iloc[i], np.int64).view(np.uint64) for i in lines]
    name = lambda text, h: mix(h ^ mix(text.astype(np.uint64) + np.uint64(1)))
    frequent = name(np.repeat(list(lines), [len(x) for x in listed]), np.concatenate(listed))
    kept = np.ones(len(raw), bool)
    kept[row] = ~np.isin(name(owner[row], line), frequent)  # a line without words has no row, and stays
    begin = 0
    for i, parts in lines.items():
        out[i] = "\n".join(x for x, k in zip(parts, kept[begin : begin + len(parts)], strict=True) if k)
        begin += len(parts)
    return pd.Series(out)


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least: int = LEAST, most: int | None = None, copies: bool = False) -> DataFrame:
    """The documents that are kept, with all their columns, and the text without its frequent lines."""
    of_id, of_key, gone, key = fresh(docs, "_of_id", "_of_key", "_gone", "_key")
    found = line_verdicts(docs, id_col, text_col, host_col, share, least, most, copies).filter("kept")
    found = found.groupBy(F.col("id").alias(of_id), F.col("text_key").alias(of_key)).agg(F.max("removed").alias(gone))
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.join(found, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)))
    return rows.withColumn(text_col, F.pandas_udf(_without, "string")(F.col(text_col), F.col(gone))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_verdicts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[x.split()[0] for x in BASE.split(", ")], "base_failed", "kept", "removed_words")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d
), m AS (
  SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         regexp_replace(translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm
  FROM l
), b AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM m WHERE words > 0 GROUP BY doc_id
), o AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source
), f AS (
  SELECT m.source, norm FROM m JOIN o ON m.source IS NOT DISTINCT FROM o.source WHERE words > 0
  GROUP BY m.source, norm HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > max(host_docs) * 0.1::DOUBLE
), x AS (
  SELECT doc_id, sum(words) AS removed_words FROM m JOIN f ON m.source IS NOT DISTINCT FROM f.source AND m.norm = f.norm GROUP BY doc_id
), y AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN x ON d.doc_id = x.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept
FROM y
"""
