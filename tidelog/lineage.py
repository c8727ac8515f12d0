"""Cuts of lineage in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; without one a local folder is made, but only where all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    A checkpointed frame still carries the constraints of the plan that it came from.
    Over the rounds of an iteration these multiply until planning takes longer than the
    work, so the rows are taken up by a new frame that knows only their schema.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    fresh = spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False)
    return DataFrame(fresh, spark)
