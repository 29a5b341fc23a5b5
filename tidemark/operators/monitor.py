"""Monitoring snapshots and organisation-wide shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.ranks import exact_quantiles

MONITORED = ("sentiment_polarity", "urgency_score", "lexical_diversity", "readability_flesch", "drift_score")


def feature_stats(scored: DataFrame, features: tuple[str, ...] = MONITORED, by: tuple[str, ...] = ()) -> DataFrame:
    """A row per snapshot and feature: mean and sample deviation."""
    there = [f for f in features if f in scored.columns]
    sums = scored.groupBy(*by).agg(*[x for f in there for x in (F.avg(f).alias(f"{f}__mean"), F.stddev_samp(f).alias(f"{f}__std"))])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"), F.col(f"{f}__std").alias("std")) for f in there]))
    return sums.select(*by, each.alias("x")).select(*by, "x.*")


def snapshot(scored: DataFrame, risk: DataFrame, features: tuple[str, ...] = MONITORED) -> DataFrame:
    """One row: when, messages, users, distributions of the features, and a summary of the risks."""
    stats = feature_stats(scored, features).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("feature_distributions"))
    size = scored.agg(F.count("*").alias("n_messages"), F.count_distinct("user").alias("n_users"))
    summary = risk_summary(risk).select(F.struct("*").alias("risk_summary"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")
    return size.join(F.broadcast(stats)).join(F.broadcast(summary)).select(now, "n_messages", "n_users", "feature_distributions", "risk_summary")  # one row each


def risk_summary(risk: DataFrame) -> DataFrame:
    means = risk.agg(F.avg("avg_drift_score").alias("mean_avg_drift"), F.avg((F.col("n_flagged_messages") > 0).cast("double")).alias("share_users_flagged"))
    return means.join(F.broadcast(exact_quantiles(risk, "avg_drift_score", (0.9,)).withColumnRenamed("q0", "p90_avg_drift")))  # one row each


def shifts(stats: DataFrame, order: str, settings: Settings | None = None) -> DataFrame:
    """Each snapshot against the one before it: the change of a mean in deviations of now. Features without deviation are skipped."""
    s = settings or Settings()
    w = Window.partitionBy("feature").orderBy(order)
    out = stats.withColumn("before", F.lag("mean").over(w)).filter(F.col("before").isNotNull() & (F.col("std").isNull() | (F.col("std") != 0)))
    out = out.withColumn("shift", F.abs(F.col("mean") - F.col("before")) / F.when(F.col("std").isNotNull(), F.greatest("std", F.lit(1e-9))))
    return out.withColumn("alert", F.coalesce(F.col("shift") >= s.shift_at, F.lit(False)))


def stats_of_snapshots(snapshots: DataFrame) -> DataFrame:
    """Persisted snapshots as a row per snapshot and feature, ordered by their time."""
    return snapshots.select("timestamp", F.explode("feature_distributions").alias("feature", "x")).select("timestamp", "feature", "x.mean", "x.std")


def org_shift(stats: DataFrame, order: str, settings: Settings | None = None) -> bool:
    """Whether any feature's newest snapshot has moved."""
    newest = stats.agg(F.max(order).alias("x")).first()["x"]
    return shifts(stats, order, settings).filter((F.col(order) == F.lit(newest)) & F.col("alert")).limit(1).count() > 0
