"""Ordered reads: bounds become filters, spans become order, offset and limit.

Every order ends with the id, so that it is total. ``ranked`` numbers rows without
gathering them in one task: rows are range-partitioned by the order, and the counts of
the partitions before are added to the number within the partition. Range bounds come
from a sample, so the partitioned rows are written once (``cut``): counting them in a
second run could meet other bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.lineage import cut


@dataclass(frozen=True)
class Bound:
    """A condition on one or more ordering columns: all, exact, half-open range [low, high), or prefix."""

    kind: str = "all"
    low: tuple = ()
    high: tuple = ()

    @classmethod
    def exact(cls, *values) -> Bound:
        return cls("exact", values)

    @classmethod
    def between(cls, low, high) -> Bound:
        """Rows from ``low`` on and below ``high``; tuples compare field by field."""
        return cls("range", low if isinstance(low, tuple) else (low,), high if isinstance(high, tuple) else (high,))

    @classmethod
    def prefix(cls, *values) -> Bound:
        """Leading fields equal, and the last given one, if a string, a prefix of the column."""
        return cls("prefix", values)

    def least(self) -> tuple:
        """Where a scan of the bound starts: its lowest key, or as much of it as the bound tells."""
        return self.low

    def condition(self, fields: list[str]) -> Column:
        if self.kind == "all":
            return F.lit(True)
        if self.kind == "exact":
            return _all([F.col(f) == v for f, v in zip(fields, self.low, strict=True)])
        if self.kind == "prefix":
            *equal, last = self.low
            end = F.col(fields[len(equal)])
            return _all([F.col(f) == v for f, v in zip(fields, equal, strict=False)] + [end.startswith(last) if isinstance(last, str) else end == last])
        if len(fields) == 1:
            return (F.col(fields[0]) >= self.low[0]) & (F.col(fields[0]) < self.high[0])
        row = F.struct(*fields)
        at = lambda values: F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, values, strict=True)])
        # the bound on the first field alone can be pushed into the scan
        return F.col(fields[0]).between(self.low[0], self.high[0]) & (row >= at(self.low)) & (row < at(self.high))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def by(rows: DataFrame, fields: list[str], bound: Bound) -> DataFrame:
    """The rows within a bound on an ordering."""
    return rows.filter(bound.condition(fields))


def listed(rows: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in order from ``offset`` on, at most ``limit``; a page past the end, or of limit 0, is empty.

    With a limit each task keeps its best ``offset + limit`` rows. Without one the rows are
    numbered where they are, so that what follows the offset never passes through one task.
    """
    if limit is not None:
        out = rows.orderBy(*order)
        return (out.offset(offset) if offset else out).limit(limit)
    if offset:
        rows = ranked(rows, order, "_at").filter(F.col("_at") > offset).drop("_at")
    return rows.orderBy(*order)


def ranked(rows: DataFrame, order: list[Column], to: str = "n", within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their number in the order, from 1; ``within`` groups of these columns, whatever their sizes."""
    return placed(rows, order, to, within).drop("_part")


def placed(rows: DataFrame, order: list[Column], to: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``ranked``, with the range partition of each row as ``_part``."""
    parts = cut(rows.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()))
    numbered = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order)))
    counts = parts.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_count"))
    before = F.coalesce(F.sum("_count").over(_earlier(within)), F.lit(0))
    starts = counts.select("_part", *within, before.alias("_before"))
    return by_part(numbered, starts, within).withColumn(to, F.col("_before") + F.col("_in")).drop("_in", "_before")


def _earlier(within: tuple[str, ...]):
    """The rows of earlier partitions, in a table of one row for each group and partition."""
    return Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def by_part(rows: DataFrame, values: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """Rows with the values of their group and partition (left out: those without)."""
    keys = ["_part", *within]
    renamed = values.withColumnsRenamed({k: f"{k}_of" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    return rows.join(renamed, _all(same)).drop(*[f"{k}_of" for k in keys])


def running_max(rows: DataFrame, value: Column, order: str, within: tuple[str, ...], to: str) -> DataFrame:
    """Rows of ``placed`` with the largest value up to each in its group: within its partition, or carried over from those before."""
    own = rows.withColumn("_value", value)
    tops = own.groupBy("_part", *within).agg(F.max("_value").alias("_top"))
    carried = tops.select("_part", *within, F.max("_top").over(_earlier(within)).alias("_carried"))
    upto = Window.partitionBy("_part", *within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    near = own.withColumn("_near", F.max("_value").over(upto))
    return by_part(near, carried, within).withColumn(to, F.greatest("_near", "_carried")).drop("_value", "_near", "_carried")


def last_key(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The greatest key of an ordering."""
    return rows.agg(F.max(F.struct(*fields)).alias("k")).select("k.*")
