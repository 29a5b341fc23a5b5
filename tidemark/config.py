"""Settings of the drift engine: windows, thresholds, weights and lexicons."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

# Results depend on these phrases, words, weights and names.

URGENCY_PHRASES = (
    "urgent", "asap", "right away", "immediately", "act now",
    "do not tell", "don't tell anyone", "keep this between us",
    "wire transfer", "gift card", "verify your password",
    "click here now", "your account will be suspended",
    "final notice", "before end of day", "confidential request",
    "bypass the process", "skip approval", "reset your credentials",
)

MANIPULATION_LEXICON = {
    "authority_spoofing": (
        "direct order from", "on behalf of the director", "ceo needs this",
        "compliance requires you to", "legal has approved this request",
        "executive request", "per instructions from senior management",
    ),
    "isolation_secrecy": (
        "do not forward this email", "keep this strictly between us",
        "do not loop in your manager", "this is off the record",
        "handle this discreetly", "do not cc anyone else",
    ),
    "artificial_scarcity": (
        "only available today", "last chance to act",
        "limited time offer", "window closes in one hour",
        "one time exception", "offer expires shortly",
    ),
    "trust_exploitation": (
        "as a valued colleague", "i know i can trust you with this",
        "just between friends", "you're the only one i can ask",
        "i trust you to handle this quietly",
    ),
    "curiosity_clickbait": (
        "you won't believe what", "click to see", "see what happened next",
        "check this out before it's too late", "you need to see this now",
    ),
}

FUNCTION_WORDS = tuple(
    """
    i me my we our you your he him his she her it its they them their
    the a an this that these those
    and or but if because as until while
    of at by for with about against between into through during
    in on to from up down out off over under
    is am are was were be been being have has had do does did
    not no nor
    """.split()
)

FEATURE_WEIGHTS = {
    "urgency_score": 2.0,
    "social_engineering_score": 1.8,
    "sentiment_polarity": 1.5,
    "sentiment_subjectivity": 1.0,
    "function_word_ratio": 1.2,
    "lexical_diversity": 1.0,
    "readability_flesch": 0.8,
    "noun_ratio": 0.7,
    "verb_ratio": 0.7,
    "contact_degree": 1.4,
    "interaction_concentration": 1.6,
}

REQUIRED_COLUMNS = ("id", "date", "user", "to", "from", "size", "attachments", "content")
STORED_NAMES = {"user_code": "user", "to_addr": "to", "from_addr": "from"}
DATE_FORMAT = "MM/dd/yyyy HH:mm:ss"

ESCALATE, MONITOR, NO_ACTION = "escalate_for_manual_review", "continue_monitoring", "no_action_needed"

ROLE_PERMISSIONS = {
    "analyst": frozenset({"view_drift", "view_users", "view_dashboard", "run_investigation", "ask_assistant"}),
    "admin": frozenset({"view_drift", "view_users", "view_dashboard", "revoke_consent", "view_audit_log", "run_investigation", "ask_assistant"}),
}

# Our own small polarity lexicon, the default of the sentiment back end.
POSITIVE_WORDS = ("good", "great", "thanks", "thank", "happy", "glad", "excellent", "love", "nice", "well", "best", "appreciate", "pleased", "win", "success")
NEGATIVE_WORDS = ("bad", "angry", "hate", "terrible", "sad", "worst", "problem", "fail", "failed", "sorry", "upset", "wrong", "unfair", "fear", "loss")


#: The salt of an unconfigured deployment: published, so its pseudonyms hide nobody. Runs warn of it.
DEVELOPMENT_SALT = "dev-salt-change-me"


@dataclass(frozen=True)
class Settings:
    """Thresholds and windows; environment variables give the defaults that a deployment changes."""

    salt: str = field(default_factory=lambda: os.getenv("TIDEMARK_SALT", DEVELOPMENT_SALT))
    consent_required: bool = True
    window: int = 30
    flag_at: float = 2.5
    clip_at: float = 10.0
    top_k: int = 10
    ingest_cap: int = 10_000
    cohort_z: float = 1.5
    org_shift_factor: float = 1.5
    shift_at: float = 2.0
    slope_at: float = 0.02
    least_points: int = 5
    disparity_at: float = 1.5
    least_bin_rows: int = 20
    escalate_rate: float = 0.15
    repeat_flags: int = 3
    contamination: float = 0.05
    trees: int = 200
    tree_rows: int = 256
    dbscan_eps: float = 0.8
    dbscan_least: int = 3
    seed: int = 42
    weights: dict = field(default_factory=lambda: dict(FEATURE_WEIGHTS))
    urgency: tuple = URGENCY_PHRASES
    lexicon: dict = field(default_factory=lambda: dict(MANIPULATION_LEXICON))
    scorer: Callable | None = None  # other back ends of functions.text.feature_columns for sentiment and parts of speech
    tagger: Callable | None = None
