"""Consent and pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.hashing import pseudonym


def consent_gate(df: DataFrame, consented: DataFrame, required: bool = True, user: str = "user") -> DataFrame:
    """Rows of users that agreed; the key is that of the windows, so the gate commutes with them."""
    return df.join(consented.select(user).distinct(), user, "left_semi") if required else df


def pseudonymize(df: DataFrame, settings: Settings | None = None, addresses: tuple[str, ...] = ("to", "from")) -> DataFrame:
    """The user, and the given address fields where they are not empty, as keyed hashes."""
    salt = (settings or Settings()).salt
    there = {a: F.when(F.col(a) != "", pseudonym(F.col(a), salt)).otherwise(F.col(a)) for a in addresses if a in df.columns}
    return df.withColumns({"user": pseudonym(F.col("user").cast("string"), salt), **there})


def revoke(ledger: DataFrame, user: str) -> DataFrame:
    return ledger.withColumn("consented", F.when(F.col("user") == user, False).otherwise(F.col("consented")))


def default_ledger(users: DataFrame, scope: str = "drift_analysis_v1") -> DataFrame:
    """For development only: everyone has agreed today."""
    return users.select("user").distinct().select("user", F.lit(True).alias("consented"), F.current_date().cast("string").alias("consented_on"), F.lit(scope).alias("scope"))


def without_content(df: DataFrame) -> DataFrame:
    """What may be persisted: no text and no addresses."""
    return df.drop("content", "to", "cc", "bcc", "from", "recipients", "tk")
