"""Connected components of an edge list, by contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.runtime import cut

ROWS_PER_PART = 250_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b); component is the least node reachable.

    In each round every node is hooked to its least neighbour, pointers are doubled
    until all show the roots of the trees so made, and the edges are renamed to the
    roots; edges within a tree then vanish, and every node that still has an edge has
    been merged with another. So rounds, and doublings in a round, grow with the
    logarithm of the nodes. Only map-side aggregated minima and joins that Spark may
    split are used; none is broadcast, because many small relations in a row would
    pass through the driver.
    """
    live = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    count = live.count()
    labels = cut(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node")))
    all_parts = _parts(labels.count())
    while count:
        parts = _parts(2 * count)
        live = live.coalesce(parts)
        both = live.union(live.select("b", "a")).toDF("node", "other")
        hook = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")).coalesce(parts))
        while True:
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("above"))
            doubled = hook.join(up.hint("merge"), "to").select("node", "above", (F.col("above") != F.col("to")).alias("moved"))
            doubled = cut(doubled.coalesce(parts))
            hook = doubled.select("node", F.col("above").alias("to"))
            if doubled.filter("moved").isEmpty():
                break
        moved = hook.select(F.col("node").alias("component"), "to")
        renamed = labels.join(moved.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = cut(renamed.coalesce(all_parts))
        for end in ("a", "b"):
            live = live.join(hook.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")).hint("merge"), end)
        left = live.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).filter("a <> b").distinct()
        live = cut(left.coalesce(parts))
        count = live.count()
    return labels


def _parts(rows: int) -> int:
    """Few partitions for few rows, so that small rounds don't leave very many small files."""
    return max(1, -(-rows // ROWS_PER_PART))
