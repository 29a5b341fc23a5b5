"""Validation and exploration of message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import exact_quantiles


def validation_profile(df: DataFrame, content: str = "content") -> DataFrame:
    """One pass: rows, null contents, users, first and last date."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(content).isNull()).alias("null_content"), F.count_distinct("user").alias("n_users"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def validate(df: DataFrame, columns: tuple[str, ...] = ("id", "date", "user", "content")) -> list[str]:
    """Raises where the table is unusable; returns warnings."""
    lacks = [c for c in columns if c not in df.columns]
    if lacks:
        raise ValueError(f"columns are missing: {', '.join(lacks)}")
    if not dict(df.dtypes)["date"].startswith("timestamp"):
        raise ValueError("date is not a timestamp")
    found = validation_profile(df).first()
    if not found["n_rows"]:
        raise ValueError("the table is empty")
    out = [f"{found['null_content']} rows have no content"] if found["null_content"] else []
    return out + (["fewer than two users"] if found["n_users"] < 2 else [])


def null_profile(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])).alias("x")).select("x.*")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in equal bins between the least and the largest value; the last bin is closed."""
    v = df.select(value.cast("double").alias("v")).filter("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = v.join(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def daily_volume(df: DataFrame, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Messages of every day from the first to the last, with zeros for days without any; on request of each user or the like."""
    counts = df.groupBy(*by, F.to_date(date).alias("day")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    days = (counts.select(*by).distinct().join(F.broadcast(ends)) if by else ends).select(*by, F.explode(F.sequence("_lo", "_hi")).alias("day"))  # one row
    return days.join(counts, [*by, "day"], "left").select(*by, "day", F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    out = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    out = out.join(F.broadcast(exact_quantiles(df, column, (0.25, 0.5, 0.75))))  # one row each
    return out.select("n", "mean", "std", "min", *[F.col(f"q{k}").alias(f"q{p}") for k, p in enumerate((25, 50, 75))], "max")
