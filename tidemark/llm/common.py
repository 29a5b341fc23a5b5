"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.adapters import dealt
from tidemark.sources.files import checkpointed as cut
from tidemark.sources.files import forget, scratch, stored
from tidemark.sources.files import shared_folder as shared_dir

__all__ = ["cut", "forget", "scratch", "shared_dir", "stored"]

#: The white space of every word and text rule here: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input."""
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def parts(rows: int, each: int) -> int:
    """How many buckets of about `each` rows the given number of rows needs."""
    return max(1, math.ceil(rows / each))


def shuffle_width(spark: SparkSession, units: float = 0, each: float = 1) -> int:
    """Partitions for a shuffle done by hand: the session's number, or more so that none holds over `each` units."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(units / each))


def uniform(seed: str, *cols: Column) -> Column:
    """A double in (0, 1) that depends on the seed and the columns' values alone; DuckDB gets the same from md5."""
    text = F.concat_ws("/", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mark(seed: str, *cols: Column) -> Column:
    """32 hexadecimal digits that depend on the seed and the columns' values alone; DuckDB's md5 gives the same."""
    return F.md5(F.concat_ws("/", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))


def uniform_of(marked: Column) -> Column:
    """A double in (0, 1) from the first 48 bits of a mark."""
    return (F.conv(F.substring(marked, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def root_of(rows: Column) -> Column:
    """How many buckets a group of so many rows is cut into: their square root, so that the rows of a bucket and the buckets
    of a group, each ordered by one task, are as few as they can be together."""
    return F.greatest(F.ceil(F.sqrt(rows)), F.lit(1)).cast("long")


#: A table of a source or the like in a row each is broadcast up to this counted number of rows, beyond it joined with salt.
FEW, SALTS = 100_000, 32


def looked_up(rows: DataFrame, small: DataFrame, keys: list[str], salt: Column, how: str = "inner", few: int = FEW) -> DataFrame:
    """rows with the other columns of a written table that has one row for each value of the keys. No key is joined by one task."""
    other = small.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in small.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    if small.count() <= few:
        return rows.join(F.broadcast(other), on, how).drop(*[f"_{k}" for k in keys])
    other = other.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return rows.join(other, on & (F.col("_salt") == F.col("_salt_")), how).drop("_salt", "_salt_", *[f"_{k}" for k in keys])


def ahead(rows: DataFrame, group: list[str], bucket: str, order: list, name: str, each: str | None = None) -> DataFrame:
    """The rows, or the sum of a column, before each row in its group (all rows if none), by the bucket and then the order: sums per
    bucket first, then rows within their bucket, so that no task orders a whole group."""
    keys, before = [*group, bucket], (Window.unboundedPreceding, -1)
    inner, head, total, *own = fresh(rows, "_inner", "_head", "_sum", *[f"_{k}" for k in keys])
    n = F.sum(each) if each else F.count("*")
    sums = rows.groupBy(*keys).agg(n.alias(total))
    over = Window.partitionBy(*(group or [F.lit(1)])).orderBy(bucket).rowsBetween(*before)
    sums = sums.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.coalesce(F.sum(total).over(over), F.lit(0)).alias(head))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
    numbers = rows.withColumn(inner, F.coalesce(n.over(within), F.lit(0)))
    on = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    return numbers.join(sums, on).withColumn(name, F.col(head) + F.col(inner)).drop(head, inner, *own)


def counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows with a number from 0 among those that agree in the keys. They are written and counted by the partition in which they
    lie, so that any number of them may agree."""
    _, part, nth = fresh(rows, name, "_part", "_nth")
    rows = cut(rows).withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id())
    return ahead(rows, keys, part, [nth], name).drop(part, nth)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The same for rows of a written table of which few agree: only those that do are brought together."""
    own = fresh(rows, *[f"_{k}" for k in keys])
    again = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]))
    on = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    alone = rows.join(again, on, "left_anti").withColumn(name, F.lit(0).cast("long"))
    return alone.unionByName(counted(rows.join(again, on, "left_semi"), keys, name))


def names_free(df: DataFrame, *wanted: str) -> None:
    """Refuses a table that lacks a needed column."""
    lacks = [c for c in wanted if c not in df.columns]
    if lacks:
        raise ValueError(f"columns are missing: {', '.join(lacks)}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where the table has columns of those names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --- Arrow batches -----------------------------------------------------------------------------------------------


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, without a copy where no row is null; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most `most` bytes each; a longer row comes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


# --- words and hashes over raw bytes -----------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACE]] = True
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def byte_codes(seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64((_ODD * (2 * seed + 1)) & _MASK))


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base & _MASK, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, base: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    return _powers(size, base)[:n], _powers(size, pow(base, -1, 1 << 64))[:n]


def prefix_hash(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """P with P[j] - P[i] = base**i times the polynomial hash of data[i:j]."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(seed)[data] * p, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans hash alike wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; offsets are those of the rows in data."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = _SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = True
    after[edge - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def counts_by_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How often each of n rows stands in rows, or the sum of its weights."""
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    return np.rint(np.bincount(rows, weights=weights.astype(np.float64), minlength=n)).astype(np.int64)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; TIDEMARK_TOKENIZERS names another folder."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
