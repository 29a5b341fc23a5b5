"""Alert policy: cohort scores, suppression while the whole organisation shifts, and transparent recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ESCALATE, MONITOR, NO_ACTION, Settings


def suppress(risk: DataFrame, org_shift: bool, settings: Settings | None = None) -> DataFrame:
    """cohort_z_score, escalation_recommended and suppressed_correlated_event; the cohort's moments are one row."""
    s = settings or Settings()
    gate = s.cohort_z * (s.org_shift_factor if org_shift else 1.0)
    cohort = risk.agg(F.avg("avg_drift_score").alias("_m"), F.coalesce(F.stddev_samp("avg_drift_score"), F.lit(0.0)).alias("_s"))
    out = risk.join(F.broadcast(cohort))  # one row
    z = F.round((F.col("avg_drift_score") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1e-9)), 4)
    out = out.withColumn("cohort_z_score", z).withColumn("escalation_recommended", F.col("cohort_z_score") >= gate)
    held = F.lit(org_shift) & (F.col("n_flagged_messages") > 0) & ~F.col("escalation_recommended")
    return out.withColumn("suppressed_correlated_event", held).drop("_m", "_s")


def prior_flags(audit: DataFrame, last: int = 100) -> DataFrame:
    """Drift events of each user among the newest entries of the audit log."""
    recent = audit.orderBy(F.desc("seq")).limit(last)
    return recent.groupBy(F.col("user_pseudonym").alias("user")).agg(F.count_if(F.col("event_type") == "drift_flagged").alias("repeat_flags"))


def recommend(risk: DataFrame, flags: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """An action for every user; a human reviews each."""
    s = settings or Settings()
    out = risk.join(flags, "user", "left") if flags is not None else risk.withColumn("repeat_flags", F.lit(0))
    out = out.withColumn("repeat_flags", F.coalesce("repeat_flags", F.lit(0)))
    high = (F.col("avg_drift_score") >= s.flag_at * 1.2) | (F.col("flagged_message_rate") > s.escalate_rate) | (F.col("repeat_flags") >= s.repeat_flags)
    action = F.when(high, ESCALATE).when(F.col("avg_drift_score") >= s.flag_at, MONITOR).otherwise(NO_ACTION)
    reason = F.format_string("average drift %.2f, flagged rate %.1f%%, %d prior flags", F.col("avg_drift_score"), F.col("flagged_message_rate") * 100, F.col("repeat_flags"))
    return out.withColumns({"recommendation": action, "rationale": reason, "requires_human_review": F.lit(True)})
