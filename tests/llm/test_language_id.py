import random
import re
import unicodedata
import zlib

import zstandard
from pyspark.sql import functions as F

from tidelog.llm import language_id as L

WORDS = {"xx": ["zorba", "klemt", "quint", "varos", "plieg"], "yy": ["ámela", "tudoç", "órfão", "neméu", "saíra"]}


def corpus(n=200):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "na"]) for _ in range(rng.randint(4, 60))), lang))
    return out


def test_held_out_accuracy_and_folds(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    dictionaries = L.train(docs.filter(~L.held_out(F.col("doc_id"))))
    rows = L.identify(docs, dictionaries).withColumn("held", L.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_is_the_smallest_compression(spark):
    texts = [(i, t * rep, g) for i, (t, g) in enumerate((t, g) for _, t, g in corpus(40)) for rep in [[1, 1, 300][i % 3]]]
    texts += [(100 + i, t[:n], g) for i, (_, t, g) in enumerate(texts[:30]) for n in [1 + i % 12]]
    dictionaries = {k: L._layout([t for _, t, g in texts if g == k]) for k in ("xx", "yy")}
    rows = {r.doc_id: r for r in L.identify(spark.createDataFrame(texts, "doc_id long, text string, lang string"), dictionaries).collect()}
    for i, text, _ in texts:
        folded = "".join(c if unicodedata.category(c)[0] in "LM" else "\0" for c in text.lower())
        folded = re.sub("\0+", " ", folded).encode()
        sizes = {}
        for lang, content in dictionaries.items():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = lambda b, raw=raw: len(zstandard.ZstdCompressor(level=5, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))
            before = content[-300:] + b" "
            sizes[lang] = sum(pack(before + folded[a : a + 8192]) - pack(before) for a in range(0, len(folded), 8192))
        best = min(sizes, key=lambda k: sizes[k])
        margin = (max(sizes.values()) - sizes[best]) / max(1, max(sizes.values()))
        assert (rows[i].lang_pred, rows[i].rejected) == (best, margin < L.MIN_MARGIN) and abs(rows[i].margin - margin) < 1e-12


def test_marks_long_texts_and_many_languages(spark):
    assert L._folded("हिन्दी-में 12 ÉTÉ") == "हिन्दी में été".encode()
    rows = [(i, f"{g}ab {g}cd {g}ef " * (30_000 if g == "q" else 5), g) for i in range(60) for g in "qrs"[: 1 + i % 3]]
    docs = spark.createDataFrame([(k, t, g) for k, (_, t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    found = L.train(docs)
    assert list(found) == ["q", "r", "s"] and all(0 < len(d) <= L.DICT_BYTES for d in found.values())
    assert list(L.train(docs, max_languages=2)) == ["q", "r"]
    predicted = L.identify(docs, found).select("lang", "lang_pred").distinct().collect()
    assert sorted(map(tuple, predicted)) == [("q", "q"), ("r", "r"), ("s", "s")]


def test_defined_cases(spark):
    docs = spark.createDataFrame(corpus(40), "doc_id long, text string, lang string")
    d = L.train(docs)
    odd = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (3, "12 !?", 5), (4, "zorba " * 40000, 5), (4, "zorba " * 40000, 5)], "doc_id long, text string, score long"
    )
    rows = sorted(L.identify(odd, d).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in rows] == ["und"] * 3 + ["xx"] * 2
    assert [r.rejected for r in rows[:3]] == [True] * 3
    assert L.identify(odd.filter("false"), d).count() == 0
    assert {r.lang_pred for r in L.identify(odd, L.train(docs.filter("false"))).collect()} == {"und"}
