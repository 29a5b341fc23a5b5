"""Keyed hashes as Catalyst expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def pads(key: str) -> tuple[str, str]:
    """The two key blocks of HMAC-SHA-256 in hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sha256(value: Column, key: str) -> Column:
    """HMAC-SHA-256 of the UTF-8 text in hex, without Python on the executors."""
    inner, outer = pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def pseudonym(user: Column, salt: str) -> Column:
    return F.concat(F.lit("emp_"), F.substring(hmac_sha256(user, salt), 1, 12))
