"""Language identification by compression with per-language zstandard dictionaries.

Texts are lower-cased, and what stands between letters (with their combining marks)
becomes a space, for training and prediction alike. For every language a raw-content
dictionary is laid out from labelled texts. A text is taken in blocks, and each block is
compressed behind the end of each dictionary; the bytes that it adds there are its size,
however short it is. The language with the fewest bytes over all blocks is chosen; where
the runner-up is nearly as small, the choice is rejected.

Training reads a bounded sample: of the ``MAX_LANGUAGES`` most frequent languages about
``SAMPLE_DOCS`` documents each, taken by a hash of doc_id below a threshold that follows
from the language's count, and of each document at most ``SAMPLE_TEXT_CHARS`` characters
from a place that its hash names; each gives pieces of up to ``PIECE_BYTES`` to a
dictionary of ``DICT_BYTES``. The driver holds no more than that per language, and the
dictionaries (64 KiB a language, 13 MB at most) are what workers get. Prediction is a
narrow stage over whole texts; lang, source and doc_id are no inputs of it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and
rejected; a tie goes to the language with more training documents, then the smaller
name, and is rejected; without any labelled text all are ``und``; with a single language
all that have letters are in it; rows without a doc_id are not held out, and not trained
on; repeated rows are predicted alike; columns of other names pass through, those that
``identify`` sets are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.runtime import map_in_arrow, share, table

SAMPLE_DOCS = 400
SAMPLE_TEXT_CHARS = 16384
MAX_LANGUAGES = 200
PIECE_BYTES = 1024
DICT_BYTES = 65536
BLOCK_BYTES = 8192
CONTEXT_BYTES = 300
LEVEL = 5  # the first one that finds matches of four bytes
MIN_MARGIN = 0.005
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_GAP = regex.compile(r"[^\p{L}\p{M}]+")


def _folded(text: str) -> bytes:
    return _GAP.sub(" ", text.lower()).encode("utf-8", "replace")


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """Dictionaries by language from (doc_id, text, lang), most frequent language first."""
    usable = labelled.select("doc_id", "text", "lang").filter("lang is not null and doc_id is not null and octet_length(text) > 0")
    top = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    counts = {r["lang"]: r["n"] for r in top.collect()}
    if not counts:
        return {}
    steps = 1 << 24
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(steps, int(steps * sample_docs / n) + 1))])
    spare = F.greatest(F.lit(1), F.char_length("text") - SAMPLE_TEXT_CHARS + 1)
    place = F.pmod(F.xxhash64("doc_id", F.lit(2)), spare).cast("int") + 1
    rows = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < share[F.col("lang")]).select(
        "lang", F.substring(F.col("text"), place, F.lit(SAMPLE_TEXT_CHARS)).alias("text"), F.xxhash64("doc_id", F.lit(1)).alias("at")
    )
    texts: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["at"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: _layout(texts.get(k, [])) for k in counts if texts.get(k)}


def _layout(texts: list[str]) -> bytes:
    """Pieces of the texts in turn, so that no long text fills the dictionary alone."""
    whole = list(dict.fromkeys(_folded(t) for t in texts))
    out, size = [], 0
    for k in range(0, max(map(len, whole), default=0), PIECE_BYTES):
        for t in whole:
            piece = t[k : k + PIECE_BYTES]
            if piece and size + len(piece) < DICT_BYTES:
                out.append(piece)
                size += len(piece) + 1
    return b"\n".join(reversed(out))  # zstandard prefers what stands near the end


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = list(dictionaries)
        self.compressors, self.contexts, self.alone = [], [], []
        for content in dictionaries.values():
            content = content if len(content) >= 8 else content.ljust(8)
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
            )
            self.contexts.append(content[-CONTEXT_BYTES:] + b" ")
            self.alone.append(len(self.compressors[-1].compress(self.contexts[-1])))

    def sizes(self, text: bytes) -> np.ndarray:
        """By language, the bytes that the blocks of the text add behind the end of its dictionary."""
        out = np.zeros(len(self.languages), dtype=np.int64)
        for a in range(0, len(text), BLOCK_BYTES):
            block = text[a : a + BLOCK_BYTES]
            for k, c in enumerate(self.compressors):
                out[k] += len(c.compress(self.contexts[k] + block)) - self.alone[k]
        return out

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
        """Language, score, relative margin to the runner-up, whether rejected."""
        if text is None or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(_folded(text))
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0, False
        above = sizes - sizes[best]
        score = 1.0 / float(np.exp(-np.minimum(above, 60) * 0.5).sum())
        margin = float(np.partition(above, 1)[1]) / max(1.0, float(np.partition(sizes, 1)[1]))
        return self.languages[best], score, margin, margin < min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The columns of docs (with text), and lang_pred, score, margin, rejected."""
    out = docs.withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0), "rejected": F.lit(False)}
    )
    shared = share(docs.sparkSession, dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            found = [classifier.predict(t.as_py(), min_margin) for t in batch.column("text")]
            for k, name in enumerate(("lang_pred", "score", "margin", "rejected")):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array([f[k] for f in found], batch.schema.field(at).type))
            yield batch

    return map_in_arrow(out, run, out.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = train(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
