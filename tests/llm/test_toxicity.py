import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidelog.llm import toxicity as X

NAMES = {v: k for k, v in vars(X).items() if isinstance(v, int) and k.isupper() and not k.startswith(("SAMPLE", "MAX", "N_"))}


def grammar(*words):
    return X.Grammar({(0, X.word_hash(w.encode())): 1.0 for w in words})


def kinds(g, text):
    row = g.features(pa.array([text]))[0]
    return {NAMES[k] for k, x in zip(X.KINDS, row, strict=True) if x > 0}


def test_clauses():
    g = grammar("fool", "rotten")
    assert kinds(g, "A fool came.") == {"INSULT"}
    assert kinds(g, "You are a fool.") == {"INSULT_AIMED"}
    assert kinds(g, "This was not a fool.") == {"INSULT_DENIED"}
    assert kinds(g, "Not now. A fool came.") == {"INSULT"}
    assert kinds(g, "Mary said that some fool came") == {"INSULT_REPORTED"}
    assert kinds(g, "I will kill you") == {"THREAT", "THREAT_AIMED"}
    assert kinds(g, "fools foolish") == set()
    assert kinds(g, "") == set()


def test_composition_is_one_run_after_the_other():
    rng = random.Random(1)
    parts = [X.Transducer.window(X.NEGATION, {X.INSULT: X.INSULT_DENIED}, 3), X.Transducer.window(X.TARGET, {X.INSULT: X.INSULT_AIMED}, 4), X.Transducer.window(X.THREAT, {X.TARGET: X.THREAT_AIMED}, 2)]
    whole = parts[0].then(parts[1]).then(parts[2])
    for _ in range(200):
        row = [rng.randrange(7) for _ in range(rng.randint(0, 30))]
        out = row
        for p in parts:
            out = p.run(out)
        assert whole.run(row) == out


def labelled(n=900):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ba", "ko", "li", "éna", "to"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        w, toxic = [word() for _ in range(rng.randint(20, 80))], int(rng.random() < 0.25)
        for _ in range(rng.randint(1, 3) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["grunk", "vexto" + word()]))
        out.append((i, " ".join(w), toxic))
    return out


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, toxic int")
    g = X.train(docs, docs.filter(~X.held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    rows = X.score(docs, g).withColumn("held", X.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held]
    assert sum((r.score >= X.CUT_OFF) == bool(r.toxic) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def one_after_the_other(g, text, insults):
    """Kinds of matched clauses, with plain words and the transducers run in turn."""
    parts = [
        X.Transducer.window(X.NEGATION, {X.INSULT: X.INSULT_DENIED, X.THREAT: X.THREAT_DENIED}, 3),
        X.Transducer.window(X.REPORT, {X.INSULT: X.INSULT_REPORTED, X.THREAT: X.THREAT_REPORTED}, 10),
        X.Transducer.window(X.TARGET, {X.INSULT: X.INSULT_AIMED}, 4),
        X.Transducer.window(X.THREAT, {X.TARGET: X.THREAT_AIMED}, 3),
    ]
    counts = dict.fromkeys(X.KINDS, 0)
    for clause in re.split(r"[\n!.:;?]", text.translate({c: c + 32 for c in range(65, 91)})):
        row = []
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause):
            kind = next((k for k, ws in ((X.TARGET, X.TARGETS), (X.NEGATION, X.NEGATIONS), (X.REPORT, X.REPORTS), (X.THREAT, X.THREATS)) if w in ws), X.OTHER)
            row.append(X.INSULT if w in insults else kind)
        row.append(X.END)
        for p in parts:
            row = p.run(row)
        for k in set(row) & set(counts):
            counts[k] += 1
    return np.log1p(list(counts.values()))


def test_features_match_a_plain_run():
    rng = random.Random(4)
    insults = ["fool", "extraordinarily", "extraordinaryfool", "bé"]
    g = grammar(*insults)
    words = [*insults, "extraordinar", "extraordinarilyso", "fools", *X.TARGETS[:3], *X.NEGATIONS[:3], *X.REPORTS[:3], *X.THREATS[:2], "plain", "words"]
    texts = ["".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in [0]) for _ in range(20)]
    texts += ["".join(x for _ in range(rng.randint(0, 40)) for x in (rng.choice(words), rng.choice([" ", " ", ", ", ". ", "\n", "? "]))) for _ in range(200)]
    assert np.allclose(g.features(pa.array(texts)), [one_after_the_other(g, t, insults) for t in texts])


def test_whole_words_and_all_stems_are_learned():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    shared = "understandings"
    toxic = [f"{word()} {word()} understandingly {word()} {shared}" for _ in range(200)]
    clean = [f"{word()} {word()} {shared} {word()} understanding" for _ in range(800)]
    found = X.learn_stems(toxic, clean)
    assert set(found) == {(0, X.word_hash(b"understandingly"))}
    many = [f"zz{k:04d}q{word()}" for k in range(3000)]
    toxic = [" ".join(f"{word()} {m}" for m in many[100 * (i % 30) : 100 * (i % 30 + 1)]) for i in range(900)]
    assert len({k for w, k in X.learn_stems(toxic, [f"{word()} {word()}" for _ in range(3000)])}) >= 1


def test_null_ids_are_not_held_out(spark):
    docs = spark.createDataFrame([(None, "fool"), (1, "x")], "doc_id long, text string")
    assert [r.held for r in docs.select(X.held_out(F.col("doc_id")).alias("held")).collect()] == [False, zlib.crc32(b"1") % 3 == 1]


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "fool " * 30000, "c"), (3, "fool " * 30000, "c")], "doc_id long, text string, score string")
    rows = sorted(X.score(docs, grammar("fool")).collect(), key=lambda r: r.doc_id)
    assert rows[0].score == rows[1].score < 0.5 < rows[2].score == rows[3].score
    assert X.score(docs.filter("false"), grammar("fool")).count() == 0
    none = X.train(docs, docs.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert np.allclose(none.weights, list(X.KINDS.values())) and not none.strength
