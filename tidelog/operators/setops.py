"""Set algebra over streams of ids: the receiver's order and duplicates are kept, except by union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.order import ranked


def intersect(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_semi")


def except_(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_anti")


def union(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Ids of either side, each once."""
    return left.select(on).union(right.select(on)).dropDuplicates([on])


def union_in_order(left: DataFrame, right: DataFrame, on: str, order: Column, to: str = "n") -> DataFrame:
    """Ids of the left in its order, then those of the right, each where it first occurs, numbered from 1."""
    sides = [rows.select(on, F.struct(F.lit(side).alias("side"), order.alias("at")).alias("_first")) for side, rows in enumerate((left, right))]
    firsts = sides[0].union(sides[1]).groupBy(on).agg(F.min("_first").alias("_first"))
    return ranked(firsts, [F.col("_first"), F.col(on)], to).drop("_first")
