"""The batch pipeline: messages to scored messages and user risk, each computed once."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEVELOPMENT_SALT, Settings
from tidemark.functions.text import feature_columns, pos_ratios, recipients, sentiment, tokens
from tidemark.operators import fairness, monitor
from tidemark.operators.anomaly import dbscan, isolation_forest
from tidemark.operators.audit import AuditLog
from tidemark.operators.baseline import with_z
from tidemark.operators.drift import flagged_rows, user_risk, with_drift
from tidemark.operators.network import with_network
from tidemark.operators.policy import suppress
from tidemark.operators.privacy import consent_gate, pseudonymize, without_content
from tidemark.operators.profile import validate
from tidemark.operators.trend import trajectory
from tidemark.sources import sinks
from tidemark.sources.files import stored
from tidemark.sources.messages import read_snapshots, read_table

TRACKED = ("urgency_score", "social_engineering_score", "sentiment_polarity", "sentiment_subjectivity", "function_word_ratio", "lexical_diversity", "readability_flesch", "noun_ratio", "verb_ratio", "contact_degree", "interaction_concentration")


@dataclass
class Result:
    scored: DataFrame
    risk: DataFrame
    warnings: list[str]


def unsafe(settings: Settings) -> list[str]:
    return ["TIDEMARK_SALT is not set: pseudonyms can be recomputed by anyone"] if settings.salt == DEVELOPMENT_SALT else []


def featured(messages: DataFrame, consented: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Consent, text features, network features on raw addresses. Texts are worked on where they lie: of what the windows bring together by the user, which
    may be a few hot ones, only numbers are needed. The gate and all windows share their key, the user, so their order makes no difference."""
    s = settings or Settings()
    df = messages if consented is None else consent_gate(messages, consented, s.consent_required)
    df = df.withColumn("recipients", recipients(F.col("to"), F.col("cc"), F.col("bcc"))).withColumn("tk", tokens(F.col("content")))
    df = df.withColumns(feature_columns(F.col("content"), F.col("tk"), s.urgency, s.lexicon, s.scorer or sentiment, s.tagger or pos_ratios)).drop("tk")
    return with_network(df, s.window)


def score(messages: DataFrame, consented: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Drift of every message, under pseudonyms. They are one to one with users and come last, so that the windows of networks and
    baselines share one exchange."""
    s = settings or Settings()
    return pseudonymize(with_drift(with_z(featured(messages, consented, s), TRACKED, s.window), TRACKED, s), s)


def run(messages: DataFrame, consented: DataFrame | None = None, settings: Settings | None = None, org_shift: bool = False, models: bool = True) -> Result:
    """Scored messages without content, and user risk with trend, cluster and policy."""
    s = settings or Settings()
    warnings = validate(messages) + unsafe(s)
    scored = stored(without_content(score(messages, consented, s)))  # risk, trend and models read numbers, and texts are worked on once
    risk = stored(user_risk(scored).join(trajectory(scored, s), "user", "left"))
    if models:
        scored, risk = isolation_forest(scored, settings=s), dbscan(risk, settings=s)
    return Result(scored, suppress(risk, org_shift, s), warnings)


def run_and_persist(spark: SparkSession, messages: DataFrame, folder: str, consented: DataFrame | None = None, labels: DataFrame | None = None, settings: Settings | None = None, log: AuditLog | None = None, models: bool = True, least: float = 0.0) -> Result:
    """The whole batch: scores and risk, a snapshot and its comparison, policy, tables, labels, audit events and the bias report.
    Monitoring and reports are guarded: their failure does not fail the run."""
    s = settings or Settings()
    warnings = validate(messages) + unsafe(s)
    found = without_content(score(messages, consented, s))
    if models:
        found = isolation_forest(stored(found), settings=s)
    sinks.write_table(found, f"{folder}/scored_messages", by_user=True)
    scored = read_table(spark, f"{folder}/scored_messages")
    risk, shift = user_risk(scored).join(trajectory(scored, s), "user", "left"), False
    if models:
        risk = dbscan(risk, settings=s)
    try:
        sinks.append_snapshot(monitor.snapshot(scored, risk), f"{folder}/snapshots")
        stats = monitor.stats_of_snapshots(read_snapshots(spark, f"{folder}/snapshots"))
        shift = monitor.org_shift(stats, "timestamp", s)
    except Exception:
        logging.getLogger(__name__).exception("the monitoring snapshot failed")
    sinks.write_table(suppress(risk, shift, s), f"{folder}/user_risk", by_user=True)
    if labels is not None:
        sinks.pseudonymized_labels(labels, s.salt).write.mode("overwrite").option("header", True).csv(f"{folder}/labels")
    if log is not None:
        for r in flagged_rows(scored, 10, least).select("user", "drift_score").collect():  # ten rows
            log.append("drift_flagged", r["user"], {"drift_score": r["drift_score"]})
    try:
        sinks.write_bias_report(fairness.bias_audit(scored, settings=s), fairness.bias_bins(scored, settings=s), f"{folder}/reports")
    except Exception:
        logging.getLogger(__name__).exception("the bias report failed")
    return Result(scored, read_table(spark, f"{folder}/user_risk"), warnings)
