"""Sinks: tables, JSON and Markdown reports, security-event lines."""

from __future__ import annotations

import json
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import pseudonym
from tidemark.sources import files

VENDOR, PRODUCT, VERSION = "Tidemark", "DriftEngine", "1.0"


def _plain(value: object) -> float | str:
    """Decimals as numbers, dates and the like as text."""
    return float(value) if isinstance(value, Decimal) else str(value)


#: Folders of a table that is laid out by user.
BUCKETS, BUCKET = 64, "user_bucket"


def bucket_of(user: Column) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int")


def of_user(df: DataFrame, user: object) -> DataFrame:
    """A user's rows; of a table that is laid out by user only the user's folder is read, and of its files the row groups that may have it."""
    value = F.lit(user).cast(df.schema["user"].dataType)
    rows = df.filter(F.col("user") == value)
    return rows.filter(F.col(BUCKET) == bucket_of(value)) if BUCKET in df.columns else rows


def write_table(df: DataFrame, path: str, jdbc: dict | None = None, by_user: bool = False) -> None:
    """Parquet, written beside the old table and put in its place: a break leaves one of them whole. By user, rows lie in a folder for each bucket of users
    (a hot one in several files), in the order of users and with a Bloom filter. Optionally a database table too."""
    out = df.write
    if by_user:
        laid = df.drop(BUCKET).withColumn(BUCKET, bucket_of(F.col("user"))).hint("rebalance", F.col(BUCKET))
        out = laid.sortWithinPartitions(BUCKET, "user").write.partitionBy(BUCKET).option("parquet.bloom.filter.enabled#user", "true")
    out.mode("overwrite").parquet(f"{path}.new")
    files.replace(df.sparkSession, f"{path}.new", path)
    if jdbc:
        df.write.format("jdbc").mode("overwrite").options(**jdbc).save()


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("append").json(path)


def pseudonymized_labels(labels: DataFrame, salt: str) -> DataFrame:
    return labels.withColumn("user", pseudonym(F.col("user").cast("string"), salt))


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Written beside the old ledger and put in its place, so that it can be derived from the old one, and one of them is always there."""
    ledger.write.mode("overwrite").option("header", True).csv(f"{path}.new")
    files.replace(ledger.sparkSession, f"{path}.new", path)


def four_digits(number: Column) -> Column:
    """A number by its exact binary value, half to even, as C's printf has it; Spark's format_string rounds the shortest decimal form half up."""

    @F.arrow_udf("string")
    def written(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.4f}" for v in values.to_pylist()], pa.string())

    return written(number)


def severity(avg_drift: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), F.bround(avg_drift * 2).cast("int")))


def cef_lines(risk: DataFrame, with_time: bool = False, vendor: str = VENDOR, product: str = PRODUCT) -> DataFrame:
    """One line per user in the common event format."""
    head = F.concat(F.lit(f"CEF:0|{vendor}|{product}|{VERSION}|LINGUISTIC_DRIFT|Insider-risk linguistic drift flagged|"), severity(F.col("avg_drift_score")), F.lit("|"))
    body = F.concat(F.lit("suser="), F.col("user").cast("string"), F.lit(" cs1Label=avgDriftScore cs1="), four_digits(F.col("avg_drift_score")), F.lit(" cs2Label=flaggedMessageRate cs2="), four_digits(F.col("flagged_message_rate")), F.lit(" cnt="), F.col("n_messages").cast("string"))
    time = F.concat(F.lit(" rt="), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")) if with_time else F.lit("")
    return risk.select("user", F.concat(head, body, time).alias("line"))


def write_cef(risk: DataFrame, path: str) -> None:
    cef_lines(risk, with_time=True).select("line").write.mode("overwrite").text(path)


def send_syslog(lines: DataFrame, host: str, port: int = 514) -> None:
    raise NotImplementedError("lines are written as text; a forwarder of the site sends them")


def write_bias_report(audit: DataFrame, bins: DataFrame, folder: str) -> None:
    """JSON and Markdown; a row per proxy and at most four bins for each."""
    rows, parts = [r.asDict() for r in audit.collect()], [r.asDict() for r in bins.orderBy("proxy", "bin").collect()]
    out = files.Folder(folder)
    out.write("bias_audit.json", json.dumps({"proxies": rows, "bins": parts}, indent=2, default=_plain))
    lines = ["# Bias audit", "", "| proxy | ratio | flagged |", "|-|-|-|", *[f"| {r['proxy']} | {r['disparity_ratio']} | {r['flagged']} |" for r in rows]]
    out.write("bias_audit.md", "\n".join(lines) + "\n")


def write_attribution(ranking: DataFrame, path: str) -> None:
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    files.Folder(folder).write(name, json.dumps([r.asDict() for r in ranking.collect()], indent=2, default=_plain))  # a row per feature
