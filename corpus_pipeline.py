"""The corpus pipeline: documents to encoded training texts, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with
the columns of ``documents``; the last adds ``ids`` and ``n_tokens``. When a stage begins,
what the ones before it broadcast is taken off the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontamination, language_id, line_dedup, minhash, pieces
from tidelog.llm.runtime import release, store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length that the text has now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some margin; ``lang`` is what was told."""
    release()
    dictionaries = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    told = language_id.identify(docs.select(*COLUMNS), dictionaries).filter(~F.col("rejected"))
    return _documents(told.withColumn("lang", F.col("lang_pred")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share."""
    release()
    return _documents(line_dedup.line_dedup(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 on five words)."""
    release()
    return _documents(minhash.deduplicate(docs.select(*COLUMNS)))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark: every span that op9 counts as hit is cut."""
    release()
    return _documents(decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), span_words=1))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its piece ids, and as text what these decode to."""
    release()
    return pieces.round_trip(docs.select(*COLUMNS), to="text").select(*COLUMNS, "ids", "n_tokens")


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_benchmarks),
    ("pieces", encode_pieces),
]

#: SQL can't express the classifier, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
