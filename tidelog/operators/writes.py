"""Writes as batches over the version log: what a batch of commands appends, and what it refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.log import KEY, ORDER, at, get, latest
from tidelog.operators.order import placed, running_max

__all__ = ["adopt", "conflicts", "guarded_batch", "insert", "key_mismatch", "mint_instants", "missing", "overlay", "removals", "revivals", "upsert"]


def overlay(base: DataFrame, staged: DataFrame, on: list[str]) -> DataFrame:
    """Staged writes over a table: rows with ``gone`` take their key away, others put or replace it."""
    kept = base.join(staged.select(*on), on, "left_anti")
    return kept.unionByName(staged.filter(~F.col("gone")).drop("gone"))


def upsert(log: DataFrame, keys: list[str]) -> DataFrame:
    """Of each natural key the last saved row, with the number of saves before it."""
    body = [c for c in log.columns if c not in keys]
    saved = log.filter("op = 'saved'")
    return saved.groupBy(*keys).agg(F.max_by(F.struct(*body), at()).alias("v"), F.count(F.lit(1)).alias("n_saved")).select(*keys, "v.*", "n_saved")


def missing(log: DataFrame, insert: Column) -> DataFrame:
    """Saves of a record that no earlier insert made: refused. ``insert`` tells inserts among saved rows."""
    first = log.filter(F.col("op") == "saved").filter(insert).groupBy(*KEY).agg(F.min(at()).alias("_first"))
    saves = log.filter(F.col("op") == "saved").filter(~insert)
    return saves.join(first, KEY, "left").filter(F.col("_first").isNull() | (at() < F.col("_first"))).drop("_first")


def removals(log: DataFrame, ids: DataFrame) -> DataFrame:
    """ids with ``took_effect``: false where the record is vacant or dead already."""
    state = get(log).select(*KEY, (~F.col("removed")).alias("living"))
    return ids.join(state, KEY, "left").select(*KEY, F.coalesce("living", F.lit(False)).alias("took_effect"))


def revivals(log: DataFrame) -> DataFrame:
    """Saves of a dead record: they go on with its history."""
    before = F.lag("op").over(Window.partitionBy(*KEY).orderBy(*ORDER))
    return log.withColumn("_before", before).filter("op = 'saved' and _before = 'removed'").drop("_before")


def conflicts(log: DataFrame, expected: DataFrame) -> DataFrame:
    """Guards (tenant, id, seq expected) whose record has another last version."""
    now = latest(log).select(*KEY, F.col("seq").alias("actual"))
    return expected.join(now, KEY, "left").filter(~F.col("actual").eqNullSafe(F.col("expected")))


def guarded_batch(log: DataFrame, batch: DataFrame, expected: DataFrame) -> DataFrame:
    """The log after an all-or-nothing batch: unchanged if any guard fails."""
    refused = conflicts(log, expected).agg(F.count(F.lit(1)).alias("_refused"))
    return log.unionByName(batch.crossJoin(F.broadcast(refused)).filter("_refused = 0").drop("_refused"))  # one row


def adopt(log: DataFrame, arriving: DataFrame) -> DataFrame:
    """The log with versions minted elsewhere, each (id, instant) once."""
    return log.unionByName(arriving).dropDuplicates([*KEY, *ORDER])


def key_mismatch(rows: DataFrame, derived: Column, stored: str) -> DataFrame:
    """Rows saved under an id that their key fields do not give."""
    return rows.filter(~derived.eqNullSafe(F.col(stored)))


def mint_instants(rows: DataFrame, clock: str, arrival: list[str], floor: Column, to: str = "instant") -> DataFrame:
    """Rows with instants above the floor of their tenant, each the clock's or one more than the one before.

    In order of arrival m(i) = max(clock(i), m(i - 1) + 1), m(0) = floor, which is
    i + max(floor, max over j <= i of clock(j) - j): a running maximum, taken within range
    partitions and carried over from one to the next, so that no tenant is gathered.
    """
    numbered = placed(rows, [F.col(c) for c in arrival], "_i", ("tenant",))
    ahead = running_max(numbered, F.col(clock) - F.col("_i"), "_i", ("tenant",), "_ahead")
    return ahead.withColumn(to, F.col("_i") + F.greatest(floor, "_ahead")).drop("_i", "_ahead", "_part")


def insert(log: DataFrame, arriving: DataFrame, clock: str, arrival: list[str]) -> DataFrame:
    """New records (tenant, body columns, clock): saved rows with ids and instants minted above what each tenant has.

    A record's id is its instant, so that no two records of a tenant share one; the
    result has the columns of the log, null where ``arriving`` has none.
    """
    floors = log.groupBy("tenant").agg(F.max(F.greatest("id", "instant")).alias("_floor"))
    known = arriving.join(floors, "tenant", "left").withColumn("_floor", F.coalesce("_floor", F.lit(0)).cast("long"))
    minted = mint_instants(known, clock, arrival, F.col("_floor"))
    own = {"id": F.col("instant"), "seq": F.col("instant"), "op": F.lit("saved")}
    return minted.withColumns(own).select(*[F.col(c) if c in {*minted.columns, *own} else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns])
