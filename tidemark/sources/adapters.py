"""The driver's tables in the roles of messages, events, networks and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt(df: DataFrame) -> DataFrame:
    """Files are read as they lie; a session that sets spark.tidemark.deal (bench.py, over tables of one file with one row group) has their rows
    dealt out to so many partitions first."""
    n = df.sparkSession.conf.get("spark.tidemark.deal", None)
    return df.repartition(int(n)) if n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents' columns."""
    return dealt(table(spark, sf_dir, "documents").select(*columns))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").alias("date"), F.col("event_id").alias("id"), "value")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "source", "doc_id", "text").select(F.col("source").alias("user"), F.col("doc_id").alias("id"), F.col("text").alias("content"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: their source writes one a second, in the order of their ids, to the readers of their language."""
    rows = texts(spark, sf_dir, "source", "doc_id", "text", "lang")
    none = F.lit("")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.timestamp_seconds("doc_id").alias("date"),
        F.col("source").alias("user"),
        F.concat("lang", F.lit("@example.org")).alias("to"),
        none.alias("cc"),
        none.alias("bcc"),
        F.concat("source", F.lit("@example.org")).alias("from"),
        F.length("text").cast("string").alias("size"),
        F.lit("0").alias("attachments"),
        F.col("text").alias("content"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as senders and suppliers as recipients of their orders; orders without lines have none."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("id"))
    joined = orders.join(lines, F.col("id") == F.col("l_orderkey"), "left")
    empty = F.array().cast("array<bigint>")
    return joined.select("user", "date", "id", F.coalesce(F.transform("x", lambda s: s["l_suppkey"]), empty).alias("recipients"))


def consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger: one user in ten has not agreed."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("user")).distinct()
    return users.withColumn("consented", F.col("user") % 10 != 0)
