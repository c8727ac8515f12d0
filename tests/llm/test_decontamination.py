import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontamination as D


def judged(docs, items, window=8):
    index = D.Index([(str(i), t) for i, t in items if t is not None], window)
    rows = list(index.judge(pa.array([t for _, t in docs], pa.string())))
    return [
        (d, n, sum(b - a for a, b in spans), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
        for (d, _), (n, spans, found) in zip(docs, rows, strict=True)
    ]


@pytest.mark.parametrize("seed", range(30))
def test_random_texts_match_brute_force(seed):
    rng = random.Random(seed)
    alphabet = ["a", "B", "cé", "d7", "ee"][: rng.randint(1, 5)]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 7, 8, 9, 20]))) for i in range(rng.randint(0, 6))]
    docs = [(i, text(rng.choice([0, 1, 2, 8, 30, 60]))) for i in range(20)] + [(99, None)]
    window = rng.choice([2, 3, 8])
    docs += [(200 + i, f"{text(3)} {t} {text(2)}") for i, (_, t) in enumerate(items)]
    assert judged(docs, items, window) == D.brute_force(docs, items, window)


def test_spark_query_and_shards(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "alpha beta"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "X one TWO three four five six seven eight! y"), (2, "alpha, beta"), (3, None), (4, ""), (4, "alpha beta one two three four five six seven eight nine")],
        "doc_id long, text string",
    )
    whole = D.contamination(docs, items)
    parts = D.contamination(docs, items, shard_bytes=15)
    got = sorted((r.doc_id, r.n_words, sum(x["to"] - x["from"] for x in r.spans), len(r["items"])) for r in whole.collect())
    assert got == sorted((r.doc_id, r.n_words, sum(x["to"] - x["from"] for x in r.spans), len(r["items"])) for r in parts.collect())
    assert got == [(1, 10, 8, 1), (2, 2, 2, 1), (3, 0, 0, 0), (4, 0, 0, 0), (4, 11, 11, 2)]


def test_decontaminate_cuts_spans_and_keeps_columns(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    keys = ["doc_id", "text", "items", "spans", "n_words", "Items_"]
    items = spark.createDataFrame([(1, passage), (2, " ".join(f"v{i}" for i in range(9)))], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(100))
    docs = spark.createDataFrame(
        [(1, f"{filler} {passage} {filler}", 5, "s", 8, 1.5), (2, filler, 6, "s", 9, None), (3, f"{passage} " + " ".join(f"v{i}" for i in range(9)), 7, "s", 10, 0.5)],
        "doc_id long, text string, items long, spans string, n_words int, Items_ double",
    )
    out = {r.doc_id: r for r in D.decontaminate(docs, items).collect()}
    assert set(out) == {1, 2}
    assert passage not in out[1].text and out[1].text.startswith(filler) and out[1].n_removed == 60
    assert out[2].text == filler and out[2].n_removed == 0
    assert list(out[1].asDict()) == [*keys, "n_removed"] and (out[1]["items"], out[1].spans, out[1].n_words, out[1].Items_) == (5, "s", 8, 1.5)
    again = D.decontaminate(docs.withColumn("n_removed", F.lit("x")), items).collect()
    assert sorted(r.n_removed for r in again) == [0, 60]


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    from tests.llm.test_textkit import thue_morse

    for k in (3, 11, 14):
        a, b = thue_morse(1 << k)
        items = [(1, f"{a} x y z"), (2, f"{b} q")]
        docs = [(1, f"so {b} x y z"), (2, f"so {a} x y z {b} q")]
        assert judged(docs, items) == D.brute_force(docs, items)
    # a hash with very few values: the bytes alone decide, and a seed is sought for the items
    real = D.Words.hashes
    monkeypatch.setattr(D.Words, "hashes", lambda self, seed=0: real(self, seed) % 64)
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(5))) for i in range(3)]
    docs = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))) for i in range(10)] + [(50, items[0][1])]
    assert judged(docs, items, 3) == D.brute_force(docs, items, 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [len(r["items"]) for r in D.contamination(docs, none).collect()] == [0]
    assert D.contamination(docs.filter(F.lit(False)), none).count() == 0
