"""Synthetic messages for demonstrations: users with their own rhythm, some of whom turn risky late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DATE_FORMAT

CALM = (
    "Hi, the {doc} is ready for review when you have time.",
    "Thanks for the update on the {doc}, see you at the meeting.",
    "Could you share the latest numbers for the {doc} this week?",
    "Lunch at noon? We can go over the {doc} afterwards.",
    "I fixed the open points in the {doc}, all good now.",
)
RISKY = (
    "This is urgent, start the wire transfer asap and don't tell anyone.",
    "Reset your credentials immediately, this is a confidential request about the {doc}.",
    "Keep this between us: I take the {doc} with me, skip approval before end of day.",
    "Final notice: verify your password and click here now for the {doc}.",
)
THINGS = ("quarterly report", "budget", "contract", "backup", "staff file", "source code")


def dice(seed: int, name: str, sides: int, *of: Column) -> Column:
    """A number from 0 to sides - 1 that depends on the seed, the name and the columns alone; DuckDB's md5 gives the same."""
    text = F.concat_ws("/", F.lit(str(seed)), F.lit(name), *[c.cast("string") for c in of])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(sides)).cast("int")


def messages(spark: SparkSession, users: int = 60, least: int = 60, most: int = 140, insiders: float = 0.05, seed: int = 42) -> DataFrame:
    """The message table; the last users are insiders, whose late messages are risky with probability 0.35."""
    users, seed, first = int(users), int(seed), int(int(users) * (1 - float(insiders)))
    u = spark.range(users)
    u = u.select(F.col("id").alias("n"), (F.lit(least) + dice(seed, "total", most - least + 1, F.col("id"))).alias("total"))
    rows = u.select("n", "total", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("k"))
    roll = lambda name, sides: dice(seed, name, sides, F.col("n"), F.col("k"))
    late = (F.col("n") >= first) & (F.col("k") > F.col("total") * 0.66) & (roll("risk", 100) < 35)
    pick = lambda values, name: F.element_at(F.array(*map(F.lit, values)), roll(name, len(values)) + 1)
    user = F.format_string("user%03d", F.col("n") + 1)
    other = F.format_string("user%03d@example.org", roll("to", users) + 1)
    when_ = F.timestamp_seconds(F.lit(1_262_304_000) + F.col("k") * 14_400 + roll("t", 7200))
    return rows.select(
        F.format_string("m%05d-%05d", "n", "k").alias("id"),
        F.date_format(when_, DATE_FORMAT).alias("date"),
        user.alias("user"),
        F.format_string("PC-%04d", "n").alias("pc"),
        other.alias("to"),
        F.lit("").alias("cc"),
        F.lit("").alias("bcc"),
        F.concat(user, F.lit("@example.org")).alias("from"),
        F.lit("send").alias("activity"),
        (roll("size", 50_000) + 500).cast("string").alias("size"),
        F.lit("0").alias("attachments"),
        F.replace(F.when(late, pick(RISKY, "risky")).otherwise(pick(CALM, "calm")), F.lit("{doc}"), pick(THINGS, "doc")).alias("content"),
    )


def labels(spark: SparkSession, users: int = 60, insiders: float = 0.05) -> DataFrame:
    first = int(users * (1 - insiders))
    return spark.range(users).select(F.format_string("user%03d", F.col("id") + 1).alias("user"), (F.col("id") >= first).cast("int").alias("is_malicious_insider"))
