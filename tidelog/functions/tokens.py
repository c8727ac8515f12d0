"""Signed tokens: claims followed by their HMAC-SHA256, made and checked by Spark's own functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

MAC_BYTES = 32
BLOCK_BYTES = 64


def pads(secret: bytes) -> tuple[bytes, bytes]:
    """The inner and the outer pad of a secret; one longer than a block is hashed first."""
    key = (hashlib.sha256(secret).digest() if len(secret) > BLOCK_BYTES else secret).ljust(BLOCK_BYTES, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def mac(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a binary column; null for null."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(secret))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def sign(claims: Column, secret: bytes) -> Column:
    return F.concat(claims, mac(claims, secret))


def claims_of(token: Column) -> Column:
    """What a token claims, signed or not; null if it is too short to hold a signature."""
    size = F.octet_length(token) - MAC_BYTES
    return F.when(size >= 0, F.substring(token, F.lit(1), size))


def fault(token: Column, secret: bytes, expires: Column, purpose: Column, now: Column, wanted: str) -> Column:
    """Why a token is refused, by the first check that fails: malformed, signature, expired, purpose; null if it holds.

    ``expires`` and ``purpose`` are read from the claims by the caller; they count only
    once the signature holds. A null token, expiry or purpose is malformed.
    """
    claims = claims_of(token)
    tag = F.substring(token, F.octet_length(token) - MAC_BYTES + 1, F.lit(MAC_BYTES))
    return (
        F.when(claims.isNull(), "malformed")
        .when(tag != mac(claims, secret), "signature")
        .when(expires.isNull() | purpose.isNull(), "malformed")
        .when(now >= expires, "expired")
        .when(purpose != wanted, "purpose")
    )
