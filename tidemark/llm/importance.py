"""Importance resampling towards a target: hashed word n-gram features by an Aho-Corasick dictionary, gains per bucket, Gumbel-top-k.

Every task keeps a dictionary of words, each between two blanks, in an automaton whose payload packs the word's CRC-32 and its length in bytes.
One scan over the bytes of a block of documents, in which A-Z are lower-cased and all that is not a word's byte is blank, emits the payloads of
its known words in order. A word that no payload covers is hashed directly and joins the dictionary, which is
bounded in words and in the length of a word; the results do not depend on what it holds. The bucket of a single word is its
payload's CRC; that of two adjacent words is composed from their payloads alone: CRC(a + blank + b) is CRC(a + blank) moved on by b's
length in GF(2), xor CRC(b). No n-gram is ever built as a string.

The buckets of a document are written once (two bytes each); counting and scoring read them. Counts cover all documents and the whole
target; a task adds up its rows before anything is shuffled, and the table of gains has one row for each bucket, whatever the input is.
The draw orders ranges of scores, not the table.

Defined results: null and empty texts have no features and weight 0; a null id is hashed as the empty text and comes last among ties;
repeated rows are drawn each by itself; an empty target has all counts 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ahead, cut, names_free, row_ranges, stored, strings, table

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
CHUNK = 1 << 20
#: A task's dictionary holds so many words at most, none of them longer in bytes; its automaton is built anew when this share of it is new.
MOST_WORDS, LONGEST, NEW_SHARE = 1 << 17, 48, 0.1
_BLANK, _POLYNOMIAL = 32, 0xEDB88320

# --- arithmetic of checksums -------------------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(_POLYNOMIAL) * (t & np.uint32(1)))
    return t


_STEP = _byte_table()
_SHORT = 64


def _applied(op: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, as four tables for the four bytes of its argument."""
    return op[0][crc & 255] ^ op[1][(crc >> 8) & 255] ^ op[2][(crc >> 16) & 255] ^ op[3][crc >> 24]


def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps that move a checksum on by 0 ... 63 bytes, and by 64, 128, 256, ..."""
    at = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    short = np.empty((_SHORT, 4, 256), np.uint32)
    for k in range(_SHORT):
        short[k] = at
        at = (at >> np.uint32(8)) ^ _STEP[at & 255]
    far = [at]
    while len(far) < 26:
        far.append(_applied(far[-1], far[-1].ravel()).reshape(4, 256))
    return short, far


_MOVE, _MOVE_FAR = _moves()


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each checksum moved on by n bytes."""
    low = n & (_SHORT - 1)
    out = _MOVE[low, 0, crc & 255] ^ _MOVE[low, 1, (crc >> 8) & 255] ^ _MOVE[low, 2, (crc >> 16) & 255] ^ _MOVE[low, 3, crc >> 24]
    high = n >> 6
    k = 0
    while high.any():
        some = np.flatnonzero(high & 1)
        out[some] = _applied(_MOVE_FAR[k], out[some])
        high, k = high >> 1, k + 1
    return out


def with_blank(crc: np.ndarray) -> np.ndarray:
    """The checksums of the same bytes and a blank."""
    c = ~crc
    return ~((c >> np.uint32(8)) ^ _STEP[(c ^ np.uint32(_BLANK)) & 255])


def composed(a: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """The checksum of a, a blank and b."""
    return moved(with_blank(a), b_length) ^ b


# --- the dictionary ----------------------------------------------------------------------------------------------

_PLAIN = np.full(256, _BLANK, np.uint8)
_PLAIN[0x30:0x3A], _PLAIN[0x61:0x7B], _PLAIN[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


class Dictionary:
    """Words between blanks, with checksum and length as payload."""

    def __init__(self, most: int = MOST_WORDS, longest: int = LONGEST) -> None:
        self.most, self.longest = most, longest
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)  # its STORE_INTS keeps 32 bits
        self.fresh: dict[bytes, int] = {}

    def _learn(self) -> None:
        if not self.fresh or (len(self.automaton) and len(self.fresh) < NEW_SHARE * len(self.automaton)):
            return
        for w, payload in itertools.islice(self.fresh.items(), self.most - len(self.automaton)):
            self.automaton.add_word(f" {w.decode('latin-1')} ", payload)
        self.fresh = {}
        self.automaton.make_automaton()

    def scan(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The payloads of the words of a text in plain bytes, which begins and ends with a blank: checksum and length (31 bits below)."""
        payloads = np.zeros(len(starts), np.int64)
        known = np.zeros(len(starts), bool)
        raw = text.tobytes()
        if len(self.automaton):
            flat = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(raw.decode("latin-1"))), np.int64)
            # A match ends at the blank behind its word, and every word has one match at most: no key lies inside another.
            at = np.searchsorted(ends, flat[0::2])
            payloads[at], known[at] = flat[1::2], True
        unknown = np.flatnonzero(~known)
        if len(unknown):
            found: dict[bytes, int] = {}
            room = len(self.automaton) < self.most
            out = []
            for a, b in zip(starts[unknown].tolist(), ends[unknown].tolist(), strict=True):
                w = raw[a:b]
                payload = found.get(w)
                if payload is None:
                    payload = found[w] = zlib.crc32(w) << 31 | len(w)
                    if room and b - a <= self.longest and len(self.fresh) < self.most:
                        self.fresh[w] = payload
                out.append(payload)
            payloads[unknown] = out
            if room:
                self._learn()
        return payloads


def features(dictionary: Dictionary, data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each feature of the rows of one block, in the order of rows, and the number of words of each row."""
    n = len(offsets) - 1
    text = np.full(len(data) + n + 1, _BLANK, np.uint8)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    text[np.arange(len(data)) + rows + 1] = _PLAIN[data]
    blank = text == _BLANK
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    payloads = dictionary.scan(text, starts, ends)
    crc, length = (payloads >> 31).astype(np.uint32), payloads & 0x7FFFFFFF
    of = np.searchsorted(offsets + np.arange(n + 1), starts, "left") - 1
    pair = np.flatnonzero(of[1:] == of[:-1])
    both = composed(crc[pair], crc[pair + 1], length[pair + 1])
    row, bucket = np.concatenate([of, of[pair]]), np.concatenate([crc, both]) % np.uint32(buckets)
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], np.bincount(of, minlength=n)


def _featured(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary()
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for a, b in row_ranges(offsets, CHUNK):
                row, bucket, n = features(dictionary, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                packed = bucket.astype("<u2").tobytes()
                ends = 2 * np.searchsorted(row, np.arange(b - a + 1))
                cells = [packed[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(cells, pa.binary())], names=["id", "n_words", "buckets"])

    return run


def featured(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words and the buckets of all features (unsigned 16-bit numbers), as a written table."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(_featured(buckets), "id long, n_words long, buckets binary"), compression="zstd")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n; a task adds up all its rows first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(strings(batch.column("buckets"))[0].view("<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, for every bucket: 1000 times the log ratio of its smoothed shares in the target and in the source, rounded down."""
    spark = source.sparkSession
    s, t = bucket_counts(source, buckets), bucket_counts(target, buckets)
    both = s.select(F.col("bucket").alias("b"), F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(t.select(F.col("bucket").alias("b"), F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(buckets).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    per = cut(both.groupBy(F.col("b").alias("bucket")).agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    sums = per.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return per.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row


def _weighed(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("buckets"))
            ends = offsets // 2
            sums = np.concatenate(([0], np.cumsum(gains[data.view("<u2")])))
            n = np.diff(ends)
            weight = np.where(n > 0, (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return run


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate that depends on seed and id alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row: id, n_words, n_features, weight and score, as a written table."""
    names_free(docs, id_col, text_col)
    names_free(target, target_text)
    own = featured(docs, id_col, text_col, buckets)
    aim = featured(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", buckets)
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(own, aim, buckets).collect():  # a row for each bucket, whatever the input is
        gains[r["bucket"]] = r["gain"]
    weighed = own.mapInArrow(_weighed(gains), "id long, n_words long, n_features long, weight long")
    return stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row: id, n_words, n_features, weight, score and rank (1, 2, ... of the drawn ones by falling score and then id; null for others). A
    draw without replacement in proportion to exp(weight / 1000)."""
    rows = scored(docs, target, id_col, text_col, target_text, buckets, seed)
    fit = F.col("n_words") >= least_words
    able = rows.filter(fit)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    ranges = cut(able.repartitionByRange(*order)).withColumn("part", F.spark_partition_id())
    ranked = ahead(ranges, [], "part", order, "before").withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    return ranked.drop("part", "before").unionByName(rows.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: The checksum of each distinct feature bit by bit.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS tag, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), f AS (
  SELECT tag, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g, 1 AS s, 0 AS t FROM d
  UNION ALL SELECT NULL, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))), 0, 1 FROM b
), c AS (
  SELECT g, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(hex(encode(g)), '..'),
           lambda p: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (('0x' || p)::BIGINT >> k) & 1)))),
           lambda c, x: xor(c >> 1, 3988292384::BIGINT * (xor(c, x) & 1)))) % 10000 AS k
  FROM (SELECT DISTINCT g FROM f)
), n AS (SELECT k, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM f JOIN c USING (g) GROUP BY k
), z AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM n
), q AS (SELECT k, CAST(floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM n, z
), e AS (SELECT tag, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN c USING (g) JOIN q USING (k) WHERE tag IS NOT NULL GROUP BY tag
), v AS (
  SELECT doc_id, tag, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features + n_features) % n_features)) // n_features, 0) AS weight,
         (('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM d LEFT JOIN e USING (tag)
), r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM v
), o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY able) AS n FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN able AND place <= 25 * n // 100 THEN CAST(place AS BIGINT) END AS rank FROM o
"""
