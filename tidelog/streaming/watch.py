"""Live watches: the version log as a stream, with the newest state of each record kept.

The log arrives in any order. State by record is the newest saved and the newest row
seen; a row not newer than the state changes nothing, which also makes repeated
delivery harmless. A watch that has read all of a log shows the same as the batch view.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.lineage import checkpoint_dir

# An empty poll makes the wait so many times longer, up to so many times the base.
IDLE_GROWTH, MAX_IDLE_FACTOR = 2, 16


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Rows of a Parquet log as they arrive, as (tenant, id, instant, seq, op)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    rows = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else reader.parquet(path)
    return rows.select(
        (F.col("user_id") % 16).alias("tenant"),
        F.col("user_id").alias("id"),
        F.col("ts").alias("instant"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "removed").otherwise("saved").alias("op"),
    )


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def watch(rows: DataFrame, tenant: int | None = None) -> DataFrame:
    """State by record of a stream of log rows: the newest saved version and the newest operation; in update mode, the records that changed."""
    own = rows if tenant is None else rows.filter(F.col("tenant") == tenant)
    at = F.struct("instant", "seq")
    return own.groupBy("tenant", "id").agg(F.max(F.when(F.col("op") == "saved", at)).alias("saved"), F.max_by("op", at).alias("last"))


def living(states: DataFrame) -> DataFrame:
    """The records whose state shows them alive, by their newest saved version."""
    return states.filter("saved is not null and last = 'saved'").select("tenant", "id", F.col("saved.seq").alias("seq"))


def deduplicated(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows delivered more than once, within a delay of event time, are passed on once; state is bounded by the delay."""
    timed = rows.withColumn("at", F.col("instant").cast("timestamp"))
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["tenant", "id", "seq"])


def follow(spark: SparkSession, path: str, name: str, tenant: int | None = None, files_per_trigger: int = 1) -> str:
    """Run a watch under a name over all that a log holds now; give the folder of its states.

    The checkpoint and the states stay in the shared folder, so that the next call of the
    same name goes on where this one ended. Each micro-batch writes the states that
    changed to a folder of its number; one that is run again writes the same folder anew.
    """
    at = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{at}/states/batch={number}")

    states = watch(stream_log(spark, path, files_per_trigger), tenant).writeStream.outputMode("update").foreachBatch(keep)
    running = states.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return f"{at}/states"


def shown(spark: SparkSession, states: str) -> DataFrame:
    """What a watch shows: of each record the state of its last micro-batch, if alive."""
    rows = spark.read.schema("tenant long, id long, saved struct<instant:timestamp_ntz,seq:long>, last string, batch long").parquet(states)
    return living(rows.groupBy("tenant", "id").agg(F.max_by(F.struct("saved", "last"), "batch").alias("s")).select("tenant", "id", "s.*"))


def replay(spark: SparkSession, path: str, tenant: int | None = None, name: str | None = None) -> DataFrame:
    """Run a watch over all that a log holds now, and give what it shows at the end; under a name it goes on from the last call."""
    return shown(spark, follow(spark, path, name or f"watch_{uuid.uuid4().hex}", tenant)).select("id", "seq")


def polled(poll: Callable[[], list], base: float, wait: Callable[[float], object] = time.sleep) -> Iterator[list]:
    """The answers of a poll that are not empty, without end; the wait grows while nothing comes and is ``base`` seconds after an answer."""
    interval = base
    while True:
        if answer := poll():
            interval = base
            yield answer
        else:
            interval = min(interval * IDLE_GROWTH, base * MAX_IDLE_FACTOR)
        wait(interval)
