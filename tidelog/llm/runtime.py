"""Session helpers shared by the operators: lineage cuts, broadcasts, free column names, table reading."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.lineage import checkpoint_dir, cut
from tidelog.shipping import map_in_arrow, tidy

__all__ = ["cut", "free_names", "map_in_arrow", "quoted", "release", "share", "store", "table", "tidy"]

_shared: list[Broadcast] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast of ``value``, which ``release`` takes off the executors."""
    found = spark.sparkContext.broadcast(value)
    _shared.append(found)
    return found


def release() -> None:
    """Take all broadcasts so far off the executors; a frame that still needs one fetches it again."""
    while _shared:
        _shared.pop().unpersist()


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, changed until no taken name is like them."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again: a cut that stays compressed and columnar."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
