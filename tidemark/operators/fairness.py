"""Bias audit: flag rates across quartiles of features that stand for who writes rather than what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.sources.files import stored

PROXIES = ("avg_word_length", "lexical_diversity", "readability_flesch")


def quartile_bins(values: DataFrame, proxy: str = "proxy", value: str = "value") -> DataFrame:
    """The bin of each value among the distinct quartile edges of its proxy, right-closed, the lowest value included. Edges are exact, from a count for
    each distinct value: proxies are rounded to two or four digits, which bounds those."""
    edges = values.groupBy(F.col(proxy).alias("_p")).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))).alias("edges"), F.count("*").alias("valid_rows"))
    out = values.join(edges, F.col(proxy) == F.col("_p")).drop("_p")  # a row per proxy
    return out.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(value)))))


def proxy_values(scored: DataFrame, proxies: tuple[str, ...] = PROXIES) -> DataFrame:
    """One row per message and proxy that has a value other than 0."""
    there = [p for p in proxies if p in scored.columns]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("proxy"), F.col(p).cast("double").alias("value")) for p in there]))
    return scored.select("drift_score", "n_flagged", each.alias("x")).select("drift_score", "n_flagged", "x.*").filter("value is not null and value <> 0")


def bias_bins(scored: DataFrame, proxies: tuple[str, ...] = PROXIES, settings: Settings | None = None) -> DataFrame:
    s = settings or Settings()
    # Edges and bins both need the values, whose text features are worked out once.
    binned = quartile_bins(stored(proxy_values(scored, proxies))).filter((F.col("valid_rows") >= s.least_bin_rows) & (F.size("edges") > 2))
    return binned.groupBy("proxy", "bin").agg(F.count("*").alias("n"), F.avg("drift_score").alias("mean_drift"), F.avg((F.col("n_flagged") > 0).cast("double")).alias("flag_rate"))


def bias_audit(scored: DataFrame, proxies: tuple[str, ...] = PROXIES, settings: Settings | None = None) -> DataFrame:
    """Per proxy: the ratio of the highest to the lowest flag rate, null where the lowest is 0, and whether it is a disparity."""
    s = settings or Settings()
    out = bias_bins(scored, proxies, s).groupBy("proxy").agg(F.count("*").alias("bins"), F.max("flag_rate").alias("hi"), F.min("flag_rate").alias("lo"))
    ratio = F.when(F.col("lo") > 0, F.round(F.col("hi") / F.nullif("lo", F.lit(0.0)), 3))
    return out.withColumn("disparity_ratio", ratio).withColumn("flagged", F.coalesce(F.col("disparity_ratio") >= s.disparity_at, F.lit(False)))
