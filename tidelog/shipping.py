"""This package on the executors' Python, whatever their path is set to."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 2 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Send the package once per application, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_tidelog_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tidelog-ship-")) / "tidelog-package.zip"
    with zipfile.ZipFile(to, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(to))
    context._tidelog_shipped = True


def tidy() -> None:
    """Give memory that is free in this process back to the system; Python workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors, which free their memory after each batch.

    Batches are held to ``BATCH_BYTES``, unless the session sets a limit of its own: what
    lies outside the heap, in the JVM and in a worker, is a few times that.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_KEY, None) == _BATCH_DEFAULT:
        df.sparkSession.conf.set(_BATCH_KEY, str(BATCH_BYTES))

    def run(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                tidy()

        yield from function(each())
        tidy()

    return df.mapInArrow(run, schema)
