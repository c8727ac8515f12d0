"""Change feeds by cursor: what a client missed since an instant (here by seq of the log)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.log import KEY, ORDER, effective_removals, get, live


def register(log: DataFrame) -> DataFrame:
    """The cursor of a new subscriber by tenant: the newest instant, with no events."""
    took = log.filter("op = 'saved'").select(*KEY, *ORDER).union(effective_removals(log).select(*KEY, *ORDER))
    return took.groupBy("tenant").agg(F.max_by("seq", F.struct(*ORDER)).alias("cursor"))


def collection_changes(log: DataFrame, since: Column) -> DataFrame:
    """(tenant, kind, id, instant, seq): each record changed since, once, by its live version, and every removal since."""
    saved = live(log).filter(F.col("instant") > since)
    removed = effective_removals(log).filter(F.col("instant") > since)
    pick = lambda rows, kind: rows.select("tenant", F.lit(kind).alias("kind"), "id", *ORDER)
    return pick(saved, "saved").union(pick(removed, "removed"))


def cursor_after(changes: DataFrame, since: Column) -> DataFrame:
    """The cursor that goes with a reply; it never goes back."""
    return changes.agg(F.greatest(F.max("instant"), since).alias("cursor"))


def unique_changes(log: DataFrame, since: DataFrame) -> DataFrame:
    """Versions after the cursor (tenant, id, since_seq), oldest first by ``instant``.

    A cursor that is no version of the record gives the live version alone, if it is newer.
    """
    saved = log.filter("op = 'saved'")
    known = saved.select(*KEY, F.col("seq").alias("since_seq"), F.col("instant").alias("_since"))
    cursors = since.join(known, [*KEY, "since_seq"], "left")
    rows = saved.join(cursors, KEY)
    follow = rows.filter(F.col("_since").isNotNull() & (F.col("instant") > F.col("_since"))).drop("_since", "since_seq")
    last = get(log).drop("removed")
    lost = last.join(cursors.filter("_since is null"), KEY).filter(F.col("seq") > F.col("since_seq")).drop("_since", "since_seq")
    return follow.unionByName(lost)


def poll(log: DataFrame, topics: DataFrame) -> DataFrame:
    """One reply to many topics: changes of each tenant since the instant that its subscriber has seen.

    topics: (tenant, since), one row each; a null since registers, and gets no events.
    """
    seen = topics.select("tenant", F.col("since").alias("_since"))
    every = live(log).select("tenant", F.lit("saved").alias("kind"), "id", *ORDER).union(
        effective_removals(log).select("tenant", F.lit("removed").alias("kind"), "id", *ORDER)
    )
    return every.join(seen, "tenant").filter(F.col("instant") > F.col("_since")).drop("_since")


def poll_cursors(log: DataFrame, topics: DataFrame) -> DataFrame:
    """The cursors that go with the reply: by tenant the newest instant, never below what was seen."""
    took = log.filter("op = 'saved'").select(*KEY, *ORDER).union(effective_removals(log).select(*KEY, *ORDER))
    top = took.groupBy("tenant").agg(F.max("instant").alias("_top"))
    return topics.join(top, "tenant", "left").select("tenant", F.greatest("_top", "since").alias("cursor"))
