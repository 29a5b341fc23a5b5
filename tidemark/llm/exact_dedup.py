"""Exact deduplication against a minimal perfect hash of historical digests.

The history is a table of distinct digests. It is cut into segments by the digest's first bits; each segment
holds a minimal perfect hash (levels of bit arrays, each key settled at the first level where it is alone) and, in
slot order, the full 32-byte digest and the locator of the winner so far. A batch is first grouped to distinct
digests by partial aggregation, so a group of copies of any size is one row before the shuffle. Each of its digests
is looked up in its segment; as a perfect hash maps strangers to some slot too, the full digest in the slot is
compared byte by byte. Members are repeats and merge with the stored winner; nonmembers are groups of their own.

Defined results: null text counts as empty; equal texts are those equal without the six ASCII white-space
characters; the winner has the most code points, then the smallest id, null ids last; of rows that agree in
all of that (repeated rows) exactly one stays. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, fresh, mix, names_free, parts, table

#: Digests in a segment of the history, about; a segment is one row of some 60 bytes a digest.
SEGMENT = 4096
#: Bits of a level for each key left; more settles more keys a level.
GAMMA = 2.0

LOCATOR = "points int, void int, id long, tag long"
SLOT = np.dtype([("points", "<i8"), ("void", "<i8"), ("id", "<i8"), ("tag", "<i8"), ("rows", "<i8")])
INDEX = "segment long, n long, levels array<binary>, sizes array<long>, digests binary, slots binary"


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), SPACE, ""), "UTF-8"), 256))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document; `tag` tells rows apart that are equal otherwise."""
    names_free(docs, id_col, text_col)
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.length(F.coalesce(text, F.lit(""))).alias("points"),
        digest(text).alias("digest"),
        F.monotonically_increasing_id().alias("tag"),
    )


def best_row() -> Column:
    """The least of these is the row that stays: most code points, an id, the smallest id, the first row."""
    return F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().cast("int").alias("void"), F.coalesce("id", F.lit(0)).alias("id"), "tag"))


def distinct_digests(rows: DataFrame, segments: int) -> DataFrame:
    return (
        rows.groupBy("digest")
        .agg(best_row().alias("best"), F.count("*").alias("rows"))
        .select(segment_of(F.col("digest"), segments).alias("segment"), "digest", "best.*", "rows")
    )


def segment_of(key: Column, segments: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 7)), 16, 10).cast("long"), F.lit(segments))


# --- the perfect hash --------------------------------------------------------------------------------------------


def _keys(digests: np.ndarray) -> np.ndarray:
    return digests[:, 8:16].copy().view("<u8").ravel() ^ mix(digests[:, 16:24].copy().view("<u8").ravel())


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits and the slot of each of the n distinct digests: a bijection onto 0 .. n - 1."""
    keys = _keys(digests)
    left, slots, levels, filled = np.arange(len(keys)), np.full(len(keys), -1, np.int64), [], 0
    while len(left):
        if len(levels) > 200:
            raise ValueError("two digests of a segment agree in 128 bits")
        size = max(8, int(len(left) * GAMMA) + 7 & ~7)
        at = _at(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[settled]] = filled + rank[at[settled]]
        filled += int(alone.sum())
        left = left[~settled]
        levels.append(alone)
    return levels, slots


def look_up(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot that each digest would have, -1 where it reaches no bit; the caller compares the full digest."""
    keys = _keys(digests)
    left, out, filled = np.arange(len(keys)), np.full(len(keys), -1, np.int64), 0
    for k, alone in enumerate(levels):
        if not len(left):
            break
        at = _at(keys[left], k, len(alone))
        hit = alone[at]
        out[left[hit]] = filled + (np.cumsum(alone) - 1)[at[hit]]
        filled += int(alone.sum())
        left = left[~hit]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _slots(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros(len(pdf), SLOT)
    for name in SLOT.names:
        out[name] = pdf[name].to_numpy()
    return out


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    matrix = _matrix(pdf["digest"])
    levels, at = build_hash(matrix)
    order = np.argsort(at)
    return pd.DataFrame(
        [(key[0], len(pdf), [np.packbits(x).tobytes() for x in levels], [len(x) for x in levels], matrix[order].tobytes(), _slots(pdf)[order].tobytes())],
        columns=["segment", "n", "levels", "sizes", "digests", "slots"],
    )


def build_history(digests: DataFrame) -> DataFrame:
    """The index over distinct digests (of distinct_digests()): one row per segment."""
    return digests.groupBy("segment").applyInPandas(_build, INDEX)


def _stored(index: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    row = index.iloc[0]
    levels = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for b, n in zip(row["levels"], row["sizes"], strict=True)]
    return levels, np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), np.frombuffer(row["slots"], SLOT)


def _merge(batch: pd.DataFrame, index: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
    """Batch digests looked up in the segment: every digest of either side once, with its winner and origin."""
    origin = np.full(len(batch), "new", object)
    columns = ["digest", *SLOT.names]
    if not len(index):
        return batch[columns].assign(origin=origin)
    levels, kept, slots = _stored(index)
    stored = pd.DataFrame({"digest": [kept[i].tobytes() for i in range(len(kept))], **{n: slots[n] for n in SLOT.names}}).assign(origin="history")
    if not len(batch):
        return stored[[*columns, "origin"]]
    matrix = _matrix(batch["digest"])
    at = look_up(levels, matrix)
    member = at >= 0
    member[member] = (kept[at[member]] == matrix[member]).all(axis=1)  # byte check: strangers get a slot too
    where, rows = at[member], batch[member].reset_index(drop=True)
    old = stored.loc[where].reset_index(drop=True)
    rank = ["points", "void", "id", "tag"]
    better = pd.Series([a < b for a, b in zip(map(tuple, rows[rank].to_numpy()), map(tuple, old[rank].to_numpy()), strict=True)], dtype=bool)
    for name in rank:
        stored.loc[where, name] = np.where(better, rows[name], old[name])
    stored.loc[where, "rows"] = (old["rows"] + rows["rows"]).to_numpy()
    stored.loc[where, "origin"] = "repeat"
    return pd.concat([stored, batch[~member][columns].assign(origin="new")], ignore_index=True)[[*columns, "origin"]]


def merge_batch(batch: DataFrame, index: DataFrame) -> DataFrame:
    """Winner, size and origin (history, repeat or new) of every digest after the batch."""
    schema = "digest binary, points long, void long, id long, tag long, rows long, origin string"
    return batch.groupBy("segment").cogroup(index.groupBy("segment")).applyInPandas(_merge, schema)


# --- the operator ------------------------------------------------------------------------------------------------


def exact_dedup(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Per row: id, tag, digest, keep_id, group_size, kept, origin. Rows for which `history` holds (it may use id)
    arrived first and build the index; the others are looked up in it."""
    rows = cut(digest_rows(docs, id_col, text_col))
    segments = parts(rows.count(), segment)
    old = F.coalesce(history, F.lit(False))
    index = build_history(distinct_digests(rows.filter(old), segments))
    winners = merge_batch(distinct_digests(rows.filter(~old), segments), index)
    winners = winners.select("digest", F.when(F.col("void") == 0, F.col("id")).alias("keep_id"), F.col("tag").alias("keep_tag"), F.col("rows").alias("group_size"), "origin")
    # The copies of one text may be a third of all rows: an inner sort-merge join, which adaptive execution splits.
    return rows.join(winners, "digest").select("id", "tag", "digest", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), "origin")


def first_arrival(id_col: str = "id") -> Column:
    """The rows that the query treats as history: half of them, by a hash of the id. The rest arrives second."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 2 == 0


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    key, of_id, of_key = fresh(docs, "_key", "_of_id", "_of_key")
    verdicts = exact_dedup(docs, first_arrival(), id_col, text_col)
    stay = verdicts.filter("kept").select(F.col("id").alias(of_id), F.col("digest").alias(of_key))
    rows = docs.withColumn(key, digest(F.col(text_col)))
    rows = rows.join(stay, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left_semi")
    return one_of_repeated(rows, id_col, key).drop(key)


def one_of_repeated(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """One row of each id and key; such groups are repeated rows alone."""
    (nth,) = fresh(rows, "_nth")
    keys = [F.col(id_col), F.col(key)]
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))).filter(F.col(nth) == 1).drop(nth)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), first_arrival())
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS nth,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, text_sha256 FROM w
"""
