"""Sharding by proportional stratified interleaving [native]; the law is `rows`.

Within each source the rows are shuffled by a seeded hash of the id and ranked; the fractional rank is
(rank - 1/2) / rows of the source. Sorted by it, every stretch of the order holds the sources in the
proportions of the whole, and the order is cut into stretches whose counts are at most one apart.

Both orders are ranked in two steps: rows are counted per bucket, the counts are accumulated (a few rows), and
rows are numbered within their bucket alone. A source has as many buckets as the square root of its rows, so no task orders a whole
source or the whole table. The shuffle is by id, source, size, checksum and the number of the row among those that
agree in these, so that rows with null ids and repeated rows are spread like all others.

Defined results: null text has size 1 and the checksum of the empty text; a null source is a source of its
own; rows that agree in id, source, size and checksum are interchangeable; an empty table
gives no rows; equal texts are not kept together, as the law is of counts; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, ahead, counted, cut, fresh, looked_up, mark, names_free, numbered, root_of, stored, table, uniform_of

SHARDS = 16
SEED = "shard-2"
ROW = ["id", "source", "checksum", "size"]


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    names_free(docs, id_col, text_col, source_col)
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("checksum"))


def interleave(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: str = SEED, few: int = FEW) -> DataFrame:
    """Per row: id, source, size, checksum, nth (among rows that agree in these), shard, slot."""
    rows = numbered(cut(keyed(docs, id_col, text_col, source_col)), ROW, "nth")
    rows = rows.withColumn("mark", mark(seed, *[F.col(c) for c in (*ROW, "nth")])).withColumn("u", uniform_of(F.col("mark")))
    per = cut(rows.groupBy("source").agg(F.count("*").alias("source_rows")))
    n = per.agg(F.sum("source_rows")).first()[0] or 0
    rows = looked_up(rows, per, ["source"], F.col("mark"), few=few).withColumn("b", F.floor(F.col("u") * root_of(F.col("source_rows"))))
    ranked = ahead(rows, ["source"], "b", ["u", "mark"], "rank").withColumn("part", (F.col("rank") + 0.5) / F.col("source_rows"))
    ranked = cut(ranked.withColumn("b", F.floor(F.col("part") * root_of(F.lit(n)))).drop("source_rows", "rank"))
    placed = ahead(ranked, [], "b", ["part", F.col("source").asc_nulls_last(), "mark"], "at")
    shard = F.expr(f"(at * {shards}) div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("long")).select("id", "source", "size", "checksum", "nth", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", files: int = 64) -> None:
    """The rows with all their columns, a folder for each shard. Rows are brought together by (shard, slot), so every file holds a stretch of
    slots in their order, the names of a shard's files are in the order of their slots, and a shard has some `files` / 16 of them or more."""
    of_id, of_source, of_sum, of_size, check, size, slot, place, row, shard = fresh(docs, "_of_id", "_of_source", "_of_sum", "_of_size", "_check", "_size", "_slot", "_place", "_row", "shard")
    names = dict(zip(ROW, (of_id, of_source, of_sum, of_size), strict=True))
    places = interleave(docs, id_col, text_col, source_col)
    places = stored(places.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("nth").alias(place), F.col("shard").alias(shard), F.col("slot").alias(slot)))
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.withColumn(check, F.crc32(raw)).withColumn(size, (F.octet_length(raw) + 1).cast("long"))
    own = (id_col, source_col, check, size)
    same = F.lit(True)
    for k, o in zip(own, names.values(), strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    # Rows that agree in all four are interchangeable: each of them takes the next of their places.
    again = stored(places.filter(F.col(place) > 0).select(*names.values()).distinct())
    several = counted(rows.join(again, same, "left_semi"), list(own), row).join(places, same & (F.col(row) == F.col(place)))
    alone = rows.join(again, same, "left_anti").join(places, same)
    every = [*docs.columns, shard, slot]
    out = alone.select(*every).unionByName(several.select(*every))
    out.repartitionByRange(files, shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).mode("overwrite").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interleave(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("checksum").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum bit by bit: each bit of the bytes, lowest first, shifts the register.
SQL = """
WITH k AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
           lambda p: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (('0x' || p)::BIGINT >> k) & 1)))),
           lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1)))) AS text_crc32
  FROM documents
), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, text_crc32, size) - 1 AS nth FROM k
), v AS (SELECT *, md5(concat_ws('/', 'shard-2', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(source, '~'), CAST(text_crc32 AS VARCHAR), CAST(size AS VARCHAR), CAST(nth AS VARCHAR))) AS mark FROM m
), d AS (SELECT *, (('0x' || substr(mark, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM v
), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, mark) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM d
), a AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / n, source NULLS LAST, mark) - 1 AS place, count(*) OVER () AS total FROM r
), s AS (SELECT *, place * 16 // total AS shard FROM a)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
