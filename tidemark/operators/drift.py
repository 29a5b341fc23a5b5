"""Drift scores of rows and their rollup to users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.text import rounded


def drift_score(features: tuple[str, ...], settings: Settings) -> Column:
    """Weighted mean of clipped absolute z-scores over those that are there; 0 without any."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    weight = {f: float(settings.weights.get(f, 1.0)) for f in features}
    # least() would skip a null
    top = add([F.when(F.col(f"z_{f}").isNotNull(), F.lit(weight[f]) * F.least(F.abs(f"z_{f}"), F.lit(settings.clip_at))).otherwise(F.lit(0.0)) for f in features])
    below = add([F.when(F.col(f"z_{f}").isNotNull(), F.lit(weight[f])).otherwise(F.lit(0.0)) for f in features])
    return F.when(below > 0, rounded(top / below, 4)).otherwise(F.lit(0.0))


def flagged_features(features: tuple[str, ...], settings: Settings) -> Column:
    marks = F.array(*[F.when(F.abs(f"z_{f}") >= settings.flag_at, F.lit(f)) for f in features])
    return F.filter(marks, lambda x: x.isNotNull())


def with_drift(df: DataFrame, features: tuple[str, ...], settings: Settings | None = None) -> DataFrame:
    s = settings or Settings()
    if not features:
        return df.withColumns({"drift_score": F.lit(0.0), "flagged_features": F.array().cast("array<string>"), "n_flagged": F.lit(0)})
    df = df.withColumns({"drift_score": drift_score(features, s), "flagged_features": flagged_features(features, s)})
    return df.withColumn("n_flagged", F.size("flagged_features"))


def user_risk(scored: DataFrame) -> DataFrame:
    """Per user: mean and highest drift, messages, flagged messages and their rate, and which features were flagged."""
    out = scored.groupBy("user").agg(
        F.avg("drift_score").alias("avg_drift_score"),
        F.max("drift_score").alias("max_drift_score"),
        F.count("*").alias("n_messages"),
        F.count_if(F.col("n_flagged") > 0).alias("n_flagged_messages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("flagged_features")))).alias("features"),
    )
    return out.withColumn("flagged_message_rate", rounded(F.col("n_flagged_messages") / F.col("n_messages"), 4))


def top_users(risk: DataFrame, k: int) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    return risk.orderBy(F.desc("avg_drift_score"), "user").limit(k)


def flagged_rows(scored: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """The rows of the highest scores, for audit events."""
    return scored.filter(F.col("drift_score") >= least).orderBy(F.desc("drift_score"), "user", "id").limit(k)
