"""Readers for the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def census(rows: DataFrame) -> DataFrame:
    """(file, bytes, blocks, rows) of the files behind a frame that was read from files; columns are not read."""
    at = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("block"))
    return at.groupBy("file").agg(F.max("bytes").alias("bytes"), F.count_distinct("block").alias("blocks"), F.count(F.lit(1)).alias("rows"))


def export_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Write columns in a fixed order as tab-separated files without a header."""
    df.select(*columns).write.csv(path, sep="\t", header=False, mode="overwrite")


def compact(df: DataFrame, path: str, order: list[str], max_records: int = 5_000_000) -> None:
    """Rewrite a table in few, sorted, compressed files, so that bounds on ``order`` skip row groups."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").option(
        "maxRecordsPerFile", max_records
    ).parquet(path, mode="overwrite")
