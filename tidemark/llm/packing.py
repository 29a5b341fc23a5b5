"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of documents in a seeded order. A window of `WINDOW` tokens gives every source a quantum, its
share of the window; a document leaves its queue in the first window in which the source's credit covers it, and what is
left of the credit is carried on. That is deficit round-robin, and it has a closed form: with quantum q, a document
whose tokens end at b in its queue leaves in window ceil(b / q). So deficits carry across windows and partitions without
any task running through the queues: prefix sums per source give the windows, prefix sums over windows give each
document's place in one stream of tokens, and the stream is cut into sequences. Within a window documents follow each other
as their credit covers them, by b / q, so that sequences carry the mixture too. Only the last sequence is padded.

Prefix sums are taken in two steps (sums per bucket, then rows within a bucket); a source has as many buckets as the square root of its
rows, so no source is ordered in one task. The order is by id, text and the number of the row among those that agree in these, so that
rows with null ids and repeated rows are spread like all others.
Tokens are written once to the shared folder; the layout reads only their number.

Defined results: null and empty texts are one token, the separator; a null source is a queue of its own, the last;
repeated rows are packed each; an empty table gives no rows; further columns are ignored; a share of zero or less, or a
source without a weight, is refused.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW, ahead, cut, looked_up, mark, names_free, numbered, root_of, row_ranges, stored, strings, table, tokenizer_file, uniform_of

TOKENIZER = "byte_bpe_50k"
SEPARATOR = 0
LENGTH = 1024
#: Tokens of a window: the stretch over which the mixture holds.
WINDOW = 64 * LENGTH
SEED = "pack-2"
CHUNK = 1 << 19

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids as the tokenizers library gives them for byte_bpe_50k.json, by the same ranks in tiktoken, which is several
    times faster (tests compare the two); a text that tiktoken can't take goes to the tokenizers library."""

    def __init__(self, name: str = TOKENIZER) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(tokenizer_file(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = Tokenizer.from_file(tokenizer_file(f"{name}.json"))
        self.plain.no_truncation()
        self.plain.no_padding()
        special = {t.content: k for k, t in self.plain.get_added_tokens_decoder().items()}
        self.special = list(special)
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all") if any(s in text for s in self.special) else self.fast.encode_ordinary(text)
        except BaseException as e:  # the limits of its regular expressions surface as a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        return self.plain.encode(text, add_special_tokens=False).ids


def _tokenized(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(name)
        for batch in batches:
            text = batch.column("text")
            _, offsets = strings(text)
            for a, b in row_ranges(offsets, CHUNK):
                ids = [np.array([*encoder.ids(t or ""), SEPARATOR], "<u4") for t in text.slice(a, b - a).to_pylist()]
                small = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in ("id", "source", "key")], pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary())],
                    names=["id", "source", "key", "n", "ids"],
                )

    return run


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """A written table: tag, id, source, key (a hash of the text), n, and ids as little-endian integers of 2 bytes, or 4 if one needs them."""
    names_free(docs, id_col, text_col, source_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_tokenized(tokenizer), "id long, source string, key long, n long, ids binary")
    return stored(rows.withColumn("tag", F.monotonically_increasing_id()), compression="zstd")


def layout(tokens: DataFrame, weights: dict[str | None, float] | None = None, window: int = WINDOW, seed: str = SEED, few: int = FEW) -> DataFrame:
    """Per row of tokens: tag, window, and at, its first token's place in the stream. Weights are by source; without them
    every window has the proportions of the whole."""
    rows = numbered(cut(tokens.select("tag", "id", "key", "source", "n")), ["id", "key", "source"], "nth")
    rows = rows.withColumn("mark", mark(seed, *[F.col(c) for c in ("id", "key", "source", "nth")])).withColumn("u", uniform_of(F.col("mark")))
    per = rows.groupBy("source").agg(F.sum("n").alias("source_n"), F.count("*").alias("source_rows"))
    if weights is None:
        per = per.withColumn("weight", F.col("source_n").cast("double"))
    else:
        if any(w <= 0 for w in weights.values()):
            raise ValueError("weights must be positive")
        given = rows.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "of string, weight double")
        per = per.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        per = per.withColumn("weight", F.coalesce("weight", F.raise_error(F.lit("a source has no weight")).cast("double")))
    per = per.withColumn("quantum", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1))) * window)
    per = cut(per.select("source", "source_rows", "quantum"))
    queued = looked_up(rows, per, ["source"], F.col("mark"), few=few).withColumn("b", F.floor(F.col("u") * root_of(F.col("source_rows"))))
    queued = ahead(queued, ["source"], "b", ["u", "mark"], "ahead", "n").withColumn("window", F.floor((F.col("ahead") + F.col("n") - 1) / F.col("quantum")))
    queued = cut(queued.select("tag", "source", "n", "ahead", "window", ((F.col("ahead") + F.col("n")) / F.col("quantum")).alias("due")))
    # Windows hold about as many rows each; so many of them make a bucket that there are about the square root of all rows.
    stretch = queued.agg(F.greatest(F.lit(1), F.ceil((F.max("window") + 1) / root_of(F.count("*"))))).first()[0]
    placed = ahead(queued.withColumn("b", F.floor(F.col("window") / (stretch or 1))), [], "b", ["window", "due", F.col("source").asc_nulls_last(), "ahead", "tag"], "at", "n")
    return placed.select("tag", "window", "at")


def _cut_up(length: int, with_ids: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            n, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "at"))
            raw = batch.column("ids")
            first = at // length
            pieces = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + nth
            begin = np.maximum(at[row], sequence * length)
            end = np.minimum(at[row] + n[row], (sequence + 1) * length)
            start, crc, last, ids, kept = begin - at[row], np.zeros(len(row), np.int64), -1, b"", []
            for k, (r, a, b) in enumerate(zip(row.tolist(), start.tolist(), (end - at[row]).tolist(), strict=True)):
                if r != last:
                    last, own = r, raw[r].as_py()
                    ids = np.frombuffer(own, "<u2").astype("<u4").tobytes() if len(own) == 2 * n[r] else own
                crc[k] = zlib.crc32(ids[4 * a : 4 * b])
                if with_ids:
                    kept.append(ids[4 * a : 4 * b])
            values = [batch.column("id").take(pa.array(row)), start, end - begin, crc, n[row], sequence, begin - sequence * length]
            columns = [v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in values]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, length: int = LENGTH, window: int = WINDOW, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence, on request with its ids as little-endian unsigned 32-bit numbers."""
    tokens = tokenized(docs, id_col, text_col, source_col, tokenizer)
    places = layout(tokens, weights, window).select(F.col("tag").alias("of_tag"), "at")
    joined = tokens.join(places, F.col("tag") == F.col("of_tag")).select("id", "n", "ids", "at")
    return joined.mapInArrow(_cut_up(length, with_ids), PIECES + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids, of pieces with ids; a sequence has at most as many pieces as tokens."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
