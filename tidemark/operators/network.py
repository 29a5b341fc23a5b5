"""Contact networks: windows over recipient entries, lifetime counts, top contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(window: int, order: tuple[str, ...] = ("date", "id")) -> tuple[Column, Column]:
    """The number of prior messages with recipients, and how to gather the last entries from it. A message that counts has an
    entry at least, so `window` of them always hold the last `window` entries."""
    ahead = Window.partitionBy("user").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum((F.size("recipients") > 0).cast("int")).over(ahead), F.lit(0))
    near = Window.partitionBy("user").orderBy("_seen").rangeBetween(-window, -1)
    entries = F.flatten(F.collect_list("recipients").over(near))
    return seen, F.when(F.size(entries) > window, F.slice(entries, -window, window)).otherwise(entries)


def with_network(df: DataFrame, window: int, order: tuple[str, ...] = ("date", "id")) -> DataFrame:
    """contact_degree and interaction_concentration over the last entries of prior messages."""
    seen, entries = history(window, order)
    # The history as an ordered list: collect_list follows the frame's order, and equal `_seen` values have at most one message with entries.
    out = df.withColumn("_seen", seen).withColumn("_h", entries)
    n = F.size("_h")
    share = F.aggregate(F.array_distinct("_h"), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter("_h", lambda x: x == c)).cast("double") / n, F.lit(2)))
    out = out.withColumn("contact_degree", F.size(F.array_distinct("_h")).cast("double"))
    return out.withColumn("interaction_concentration", F.when(n > 0, share).otherwise(F.lit(0.0))).drop("_seen", "_h")


def edges(df: DataFrame) -> DataFrame:
    return df.select("user", "date", "id", F.posexplode("recipients").alias("place", "contact"))


def lifetime(df: DataFrame) -> DataFrame:
    """Messages of each user to each contact, over all time."""
    return edges(df).groupBy("user", "contact").agg(F.count("*").alias("entries"))


def lifetime_degree(df: DataFrame) -> DataFrame:
    return edges(df).groupBy("user").agg(F.count_distinct("contact").alias("contacts"), F.count("*").alias("entries"))


def top_contacts(df: DataFrame, window: int, k: int = 5) -> DataFrame:
    """The most frequent contacts among each user's last entries."""
    last = Window.partitionBy("user").orderBy(F.desc("date"), F.desc("id"), F.desc("place"))
    recent = edges(df).withColumn("_nth", F.row_number().over(last)).filter(F.col("_nth") <= window)
    counts = recent.groupBy("user", "contact").agg(F.count("*").alias("entries"))
    rank = Window.partitionBy("user").orderBy(F.desc("entries"), "contact")
    return counts.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= k)
