"""Line deduplication across documents, in DataFrame functions alone.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased. A key of at least ``min_chars`` code points that is found in at least
``min_docs`` documents loses all its lines, except those of the largest doc_id that
holds it.

Plan: lines become 96-bit key hashes with their document and position; those rows
(no text) are range-partitioned by hash and a document-derived salt, sorted within
by document and position, and streamed by a window that lets the first occurrence
of each (key, document) through. Counting these per key needs one row per key and
salt after map-side aggregation, so that a line which a third of all documents hold
spreads over as many groups as there are ``SALT_ROWS`` rows, ``LEAST_SALTS`` at least.
What comes back per document is a bitmap compressed by words: 64 lines to a word, words
without a dropped line left out.

Texts are only shuffled where lines are dropped: a bit set of the documents concerned (by
hash, at most 2**``MOST_BITS`` bits, that is 16 MB) is broadcast, and a document whose bit
is not set stays where it is. For that the input is read twice.

Defined cases: a null or empty text is one empty line; rows of the same doc_id are
one document for counting, and each of them loses the same lines; a null doc_id is
a document below all others (all rows with a null doc_id together); an empty table
gives no rows; further columns of the input pass through, whatever their names, but that
n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.runtime import cut, free_names, quoted, table

MIN_CHARS = 40
MIN_DOCS = 5
LEAST_SALTS, SALT_ROWS = 64, 250_000
WORD = 64
LEAST_BITS, MOST_BITS = 15, 27
PAGE = 32_768  # bits of a row that bitmap_construct_agg makes

# The six bytes stripped at both ends, and the letters folded.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The comparison key of a line; ``lower`` is exact, and faster, where all is ASCII."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, UPPER, UPPER.lower())
    )


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, tk, pos) of every line whose key is long enough; tk tells texts of one doc_id apart."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("tk"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.filter(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.hash("key", F.lit(7)).alias("h2"), "doc_id", "tk", "pos"
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, tk, keep_words, n_dropped) of each document text that loses lines.

    ``keep_words`` maps a word's number to 64 keep bits, bit i for line 64 * word + i;
    a word that is not in the map keeps all its lines.
    """
    occurrences = cut(line_occurrences(docs, min_chars))
    salts = max(LEAST_SALTS, occurrences.count() // SALT_ROWS)
    occurrences = occurrences.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    ranged = occurrences.repartitionByRange("h1", "h2", "salt")
    by_key = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc_nulls_last(), "tk", "pos")
    firsts = ranged.withColumn("rank", F.rank().over(by_key)).withColumn("before", F.lag("doc_id").over(by_key)).filter(
        (F.col("rank") == 1) | ~F.col("before").eqNullSafe(F.col("doc_id"))
    )
    counts = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    # cut, so that the join shuffles both sides anew and Spark may split a key that very many documents hold
    repeated = cut(counts.filter(F.col("n_docs") >= min_docs).drop("n_docs"))
    dropped = occurrences.drop("salt").join(repeated, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    words = dropped.groupBy("doc_id", "tk", F.expr(f"cast(pos div {WORD} as int)").alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )
    return words.groupBy("doc_id", "tk").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep_words"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
    )


def kept_text(text: Column, keep_words: Column) -> Column:
    """The text without the lines whose keep bit is 0."""

    def keeps(_: Column, i: Column) -> Column:
        word = F.element_at(keep_words, F.floor(i / WORD).cast("int"))
        return word.isNull() | (F.getbit(word, (i % WORD).cast("int")) == 1)

    return F.when(keep_words.isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.filter(_lines(text), keeps), "\n")
    )


def _bit_set(flags: DataFrame) -> tuple[DataFrame, int]:
    """(page, bits) of the documents in flags (doc_id, tk) by their hash, and the number of bits in all."""
    wanted = 16 * flags.count()
    size = 1 << min(MOST_BITS, max(LEAST_BITS, wanted.bit_length()))
    at = F.pmod(F.xxhash64("doc_id", "tk"), F.lit(size))
    return flags.groupBy(F.floor(at / PAGE).alias("page")).agg(F.bitmap_construct_agg(at % PAGE).alias("bits")), size


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input's columns, with ``text`` cut to the kept lines, and n_lines, n_dropped."""
    flags = cut(keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    pages, size = _bit_set(flags)
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own_id, own_tk, keep, n, at, page, bits = free_names(docs.columns, "_id", "_tk", "_keep", "_n", "_at", "_page", "_bits")

    placed = docs.select(*map(quoted, rest), F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(size)).alias(at))
    pages = F.broadcast(pages.withColumnsRenamed({"page": page, "bits": bits}))
    marked = placed.join(pages, F.floor(F.col(at) / PAGE) == F.col(page), "left")
    spot = F.col(at) % PAGE
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    concerned = F.coalesce(F.getbit(byte, (spot % 8).cast("int")) == 1, F.lit(False))

    flags = flags.withColumnsRenamed({"doc_id": own_id, "tk": own_tk, "keep_words": keep, "n_dropped": n})
    moved = marked.filter(concerned).join(flags, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_tk)), "left")

    def result(rows: DataFrame, keep_words: Column, dropped: Column) -> DataFrame:
        counts = [F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped")]
        return rows.select(*[kept_text(F.col("text"), keep_words).alias(c) if c == "text" else quoted(c) for c in rest], *counts)

    whole = F.lit(None).cast("map<int,bigint>")
    return result(moved, F.col(keep), F.col(n)).union(result(marked.filter(~concerned), whole, F.lit(0)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
flagged AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
