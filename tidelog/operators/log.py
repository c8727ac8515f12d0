"""Views over the append-only version log (tenant, id, instant, seq, op, body columns).

``op`` is ``saved`` or ``removed``; (instant, seq) orders the versions of a record.
Views of the present are aggregations with a map-side part, so that no record, however
many versions it has, gathers in one task. Views of history need the versions of a
record in order: windows by (tenant, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.order import ranked

KEY = ["tenant", "id"]
ORDER = ["instant", "seq"]


def at() -> Column:
    return F.struct(*ORDER)


def _body(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in KEY]


def latest(log: DataFrame, when: Column | None = None) -> DataFrame:
    """The last row of each record, of those for which ``when`` holds."""
    rows = log if when is None else log.filter(when)
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*_body(log)), at()).alias("v")).select(*KEY, "v.*")


def get(log: DataFrame) -> DataFrame:
    """The last saved version of each record, and whether it is removed: removed records can still be read."""
    last = F.max_by(F.struct(*_body(log)), F.when(F.col("op") == "saved", at()))
    ended = F.max_by("op", at()) == "removed"
    return log.groupBy(*KEY).agg(last.alias("v"), ended.alias("removed")).filter("v is not null").select(*KEY, "v.*", "removed")


def live(log: DataFrame) -> DataFrame:
    """The records that are not removed, by their last saved version."""
    return get(log).filter(~F.col("removed")).drop("removed")


def classify(log: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (tenant, id) with state: living, dead, or vacant where nothing was ever saved."""
    state = F.when(F.col("removed").isNull(), "vacant").when(F.col("removed"), "dead").otherwise("living")
    return ids.join(get(log).select(*KEY, "removed"), KEY, "left").select(*KEY, state.alias("state"))


def _history() -> object:
    return Window.partitionBy(*KEY).orderBy(*ORDER)


def effective_removals(log: DataFrame) -> DataFrame:
    """Removals of a living record; those of a vacant or dead one change nothing."""
    return log.withColumn("_before", F.lag("op").over(_history())).filter("op = 'removed' and _before = 'saved'").drop("_before")


def versions(log: DataFrame) -> DataFrame:
    """Saved versions with previous and next (by seq), and whether a removal followed before the next one."""
    marked = log.withColumn("_after", F.lead("op").over(_history()))
    saved = marked.filter("op = 'saved'")
    return saved.withColumns(
        {
            "previous": F.lag("seq").over(_history()),
            "next": F.lead("seq").over(_history()),
            "removed": F.coalesce(F.col("_after") == "removed", F.lit(False)),
        }
    ).drop("_after")


def history(log: DataFrame) -> DataFrame:
    """Saved versions with ``n``, 1 for the newest of a record."""
    newest = Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in ORDER])
    return log.filter("op = 'saved'").withColumn("n", F.row_number().over(newest))


def as_of(log: DataFrame, instant: Column) -> DataFrame:
    """What was live at an instant."""
    return live(log.filter(F.col("instant") <= instant))


def recency(log: DataFrame) -> DataFrame:
    """Living records with ``n``, 1 for the most recently written of its tenant; a tenant may span any number of tasks."""
    return ranked(live(log), [F.desc("instant"), F.desc("seq")], "n", within=("tenant",))


def instant_floor(log: DataFrame) -> DataFrame:
    """By tenant, the seq of the newest row that took effect: a new instant lies above it."""
    took_effect = log.filter("op = 'saved'").select(*KEY, *ORDER).union(effective_removals(log).select(*KEY, *ORDER))
    return took_effect.groupBy("tenant").agg(F.max_by("seq", at()).alias("floor"))
