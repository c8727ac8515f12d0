"""Refresh tokens that rotate: each is good once, and one that comes again revokes its session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.order import ranked


def rotate(presented: DataFrame, session: str, order: list[str], token: Column, minted: Callable[[Column], Column], valid: Column) -> DataFrame:
    """Presented tokens with their ``outcome``: rotated, revoked (it revokes the session) or refused.

    A session keeps the hash of its latest token only. ``minted`` gives the token of a
    generation, from 0; a token is taken if it hashes as that of as many rotations as there
    were before, and the first that does not revokes the session, so that all later ones
    are refused. One that is not ``valid`` (forged, expired, of another tenant, null) is
    refused and changes nothing. The n-th valid token must be of generation n - 1: numbers
    and an aggregate by session tell it, without gathering a session.
    """
    known = presented.withColumns({"_valid": F.coalesce(valid & token.isNotNull(), F.lit(False)), "_hash": F.sha2(token, 256)})
    numbered = ranked(known.filter("_valid"), [F.col(c) for c in order], "_n", (session,))
    wrong = numbered.filter(F.col("_hash") != F.sha2(minted(F.col("_n") - 1), 256))
    ends = wrong.groupBy(F.col(session).alias("_session")).agg(F.min("_n").alias("_end"))
    joined = numbered.join(ends, F.col(session).eqNullSafe(F.col("_session")), "left")
    told = F.when(F.col("_n") > F.col("_end"), "refused").when(F.col("_n") == F.col("_end"), "revoked").otherwise("rotated")
    judged = joined.withColumn("outcome", told).drop("_n", "_session", "_end")
    return judged.unionByName(known.filter("NOT _valid").withColumn("outcome", F.lit("refused"))).drop("_valid", "_hash")
