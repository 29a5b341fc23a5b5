"""What an application asks for: guarded look-ups, investigations and intents over persisted tables."""

from __future__ import annotations

import hmac
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import ROLE_PERMISSIONS, Settings
from tidemark.operators.audit import AuditLog
from tidemark.operators.drift import top_users
from tidemark.operators.monitor import shifts, stats_of_snapshots
from tidemark.operators.policy import prior_flags, recommend
from tidemark.operators.privacy import revoke
from tidemark.operators.retrieval import STOP_WORDS, answer
from tidemark.sources.messages import read_audit
from tidemark.sources.sinks import BUCKET, of_user, write_ledger

EXPOSED = ("date", "drift_score", "n_flagged", "flagged_features", "sentiment_polarity", "sentiment_subjectivity", "urgency_score", "social_engineering_score", "readability_flesch", "lexical_diversity", "contact_degree", "interaction_concentration")
RECENT, RECENT_COLUMNS = 15, ("date", "drift_score", "n_flagged", "flagged_features", "sentiment_polarity", "urgency_score")


class NotReady(Exception):
    """The pipeline has not been run yet."""


class NotFound(Exception):
    """There is no such user."""


class Denied(Exception):
    """Unknown token, or a role without the permission."""


def role_of(token: str | None, tokens: dict[str, str]) -> str:
    for known, role in tokens.items():
        if token is not None and hmac.compare_digest(known, token):
            return role
    raise Denied("unknown token")


def check_permission(role: str, permission: str) -> None:
    if permission not in ROLE_PERMISSIONS.get(role, frozenset()):
        raise Denied(f"{role} may not {permission}")


def verify_secret(given: str | None, secret: str) -> None:
    if given is None or not hmac.compare_digest(given, secret):
        raise Denied("wrong secret")


def allow_listed(df: DataFrame, allowed: tuple[str, ...] = EXPOSED) -> DataFrame:
    return df.select(*[c for c in allowed if c in df.columns])


def recent_messages(scored: DataFrame, user: str | None = None, n: int = RECENT, columns: tuple[str, ...] = RECENT_COLUMNS, order: tuple[str, ...] = ("date", "id")) -> DataFrame:
    """The newest rows of one user, or of each, in time order."""
    rows = scored if user is None else of_user(scored, user)
    w = Window.partitionBy("user").orderBy(*[F.desc(c) for c in order])
    rows = rows.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n)
    keep = dict.fromkeys(c for c in ("user", "id", *columns) if c in rows.columns)
    return rows.select(*keep).orderBy("user", *[c for c in order if c in keep])


class Service:
    """Reads over the two persisted tables, each checked against the actor's role and logged. A front end that acts for people who are not
    known by name (the assistant) may do what an analyst may, and shows its secret where one is set."""

    def __init__(self, risk: DataFrame | None, scored: DataFrame | None, log: AuditLog | None = None, settings: Settings | None = None, generator: Callable[[str, list[dict]], str | None] | None = None, passages: DataFrame | None = None, secret: str | None = None) -> None:
        self.risk, self.scored, self.log, self.settings, self.generator, self.passages = risk, scored, log, settings or Settings(), generator, passages
        self.secret = secret

    def _allow(self, actor: str, permission: str) -> None:
        check_permission({"assistant": "analyst"}.get(actor, actor), permission)

    def _log(self, event: str, user: str | None, details: dict, actor: str) -> None:
        if self.log is not None:
            self.log.append(event, user, details, actor)

    def _row(self, user: str) -> dict:
        if self.risk is None:
            raise NotReady
        row = of_user(self.risk, user).drop(BUCKET).first()
        if row is None:
            raise NotFound(user)
        return row.asDict()

    def riskiest(self, k: int | None = None, actor: str = "analyst") -> list[dict]:
        self._allow(actor, "view_users")
        if k is not None and k <= 0:
            raise ValueError("k must be positive")
        if self.risk is None:
            raise NotReady
        self._log("api_access", None, {"what": "riskiest"}, actor)
        return [r.asDict() for r in top_users(self.risk, self.settings.top_k if k is None else k).select("user", "avg_drift_score").collect()]  # k rows

    def user(self, user: str, actor: str = "analyst") -> dict:
        self._allow(actor, "view_users")
        self._log("api_access", user, {"what": "user"}, actor)
        return self._row(user)

    def messages(self, user: str, actor: str = "analyst") -> DataFrame:
        self._allow(actor, "view_drift")
        if self.scored is None:
            raise NotReady
        self._log("api_access", user, {"what": "messages"}, actor)
        return allow_listed(of_user(self.scored, user))

    def explain(self, user: str, actor: str = "analyst") -> dict:
        self._allow(actor, "view_drift")
        row = self._row(user)
        if row["avg_drift_score"] < self.settings.flag_at:
            return {"user": user, "explanation": None, "reason": "the score is below the threshold for explanations"}
        if self.generator is None:
            return {"user": user, "explanation": None, "reason": "no text generator is configured"}
        text = self.generator(f"Why did the communication of {user} change? Flagged: {', '.join(row.get('features') or ())}", [row])
        self._log("explanation_generated", user, {"given": text is not None}, actor)
        return {"user": user, "explanation": text, "reason": None if text else "the text generator gave nothing"}

    def prior_flags(self) -> DataFrame | None:
        """How often the newest entries of the own log flag each user."""
        if self.log is None or not self.log.folder.names(".jsonl"):
            return None
        return prior_flags(read_audit(self.risk.sparkSession, self.log.path))

    def investigate(self, user: str, flags: DataFrame | None = None, actor: str = "analyst") -> dict:
        """Risk, newest messages, prior flags (of the own log, unless given), passages where the score calls for them, and a
        recommendation for a human."""
        self._allow(actor, "run_investigation")
        try:
            row = self._row(user)
        except NotFound:
            return {"user": user, "error": f"no data for {user}", "requires_human_review": True}
        steps = ["risk summary"]
        recent = [r.asDict() for r in recent_messages(self.scored, user).collect()] if self.scored is not None else []  # a few rows
        steps.append("recent messages")
        flags = self.prior_flags() if flags is None else flags
        steps += ["prior flags"] if flags is not None else []
        advice = recommend(of_user(self.risk, user), flags, self.settings).first()
        sources = []
        if row["avg_drift_score"] >= self.settings.flag_at and self.passages is not None:
            sources = answer("when is an escalation reviewed by a human", self.passages, 2, stop=STOP_WORDS)["sources"]
            steps.append("governance passages")
        steps.append("recommendation")
        self._log("investigation", user, {"action": advice["recommendation"]}, actor)
        return {"user": user, "risk": row, "recent_messages": recent, "repeat_flags": advice["repeat_flags"], "sources": sources, "recommendation": advice["recommendation"], "rationale": advice["rationale"], "steps": steps, "requires_human_review": True}

    def audit_log_is_valid(self, spark: SparkSession, actor: str) -> bool:
        self._allow(actor, "view_audit_log")
        return self.log is None or self.log.verify(spark)

    def newest_snapshot(self, snapshots: DataFrame, actor: str = "analyst") -> dict | None:
        """The newest monitoring snapshot, and the features that moved since the one before."""
        self._allow(actor, "view_dashboard")
        newest = snapshots.orderBy(F.desc("timestamp")).limit(1).collect()
        if not newest:
            return None
        self._log("api_access", None, {"what": "snapshot"}, actor)
        moved = shifts(stats_of_snapshots(snapshots), "timestamp", self.settings).filter((F.col("timestamp") == newest[0]["timestamp"]) & F.col("alert"))
        return {"snapshot": newest[0].asDict(True), "moved": sorted(r["feature"] for r in moved.select("feature").collect())}  # a few features

    def revoke_consent(self, ledger: DataFrame, path: str, user: str, actor: str) -> None:
        self._allow(actor, "revoke_consent")
        write_ledger(revoke(ledger, user), path)
        self._log("consent_revoked", None, {}, actor)

    def ask(self, question: str, k: int = 4, actor: str = "analyst") -> dict:
        """Passages, and an answer where a generator is given."""
        self._allow(actor, "ask_assistant")
        if self.passages is None:
            raise NotReady
        self._log("rag_query", None, {"k": k}, actor)
        return answer(question, self.passages, k, self.generator, STOP_WORDS)

    def assistant(self, intent: str, parameters: dict | None = None, secret: str | None = None) -> dict:
        """The intents of a conversational front end."""
        if self.secret is not None:
            verify_secret(secret, self.secret)
        p = parameters or {}
        if self.risk is None:
            return {"text": "The pipeline has not been run yet."}
        if intent == "top_risky_users":
            top = self.riskiest(int(p.get("k", self.settings.top_k)), "assistant")
            return {"text": "\n".join(f"{r['user']}: drift score {r['avg_drift_score']:.2f}" for r in top), "data": top}
        if intent == "investigate_user":
            found = self.investigate(p.get("user_pseudonym", ""), actor="assistant")
            return {"text": found.get("error") or f"{found['recommendation']}: {found['rationale']}. A human decides.", "data": found}
        if intent == "user_summary":
            try:
                r = self.user(p.get("user_pseudonym", ""), "assistant")  # checked and logged as every other look-up
            except NotFound:
                return {"text": "No data for this user."}
            return {"text": f"{r['user']}: average drift {r['avg_drift_score']:.2f}, {r['n_flagged_messages']} of {r['n_messages']} messages flagged.", "data": r}
        return {"text": f"unknown intent: {intent}"}
