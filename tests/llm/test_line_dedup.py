import hashlib
import random

from pyspark.sql import functions as F

from tidelog.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs, min_chars=40, min_docs=5):
    held = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, docs, *args):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_dropped", F.lit("x"))
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.line_dedup(frame, *args).collect())


def test_matches_brute_force(spark):
    rng = random.Random(9)
    shared = [" ".join(rng.choice(["Alpha", "beta", "ÉCOLE", "x"]) for _ in range(rng.randint(5, 14))) for _ in range(12)]
    docs = [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "y" * 50000 + "\n" + shared[0])]
    for i in range(120):
        lines = []
        for _ in range(rng.choice([0, 1, 5, 90])):
            line = rng.choice(shared) if rng.random() < 0.5 else f"own line {i} {rng.random()} with enough letters to count"
            lines.append(rng.choice(["", " ", "\t"]) + rng.choice([line, line.upper() if line.isascii() else line]) + rng.choice(["", "\r", "  "]))
        docs.append((i, "\n".join(lines)))
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs, 10, 2) == brute(docs, 10, 2)


def test_repeated_rows_are_one_document(spark):
    line = "a line that is long enough to be counted at all"
    docs = [(1, line)] * 6
    assert run(spark, docs) == [(1, 1, 0, line)] * 6
    docs += [(i, line) for i in range(2, 6)]
    assert run(spark, docs) == sorted([(1, 1, 1, "")] * 6 + [(i, 1, 1, "") for i in range(2, 5)] + [(5, 1, 0, line)])


def test_columns_with_the_names_used_inside(spark):
    line = "a third line that is long enough to be counted at all"
    names = ["_id", "_tk", "_keep", "_n", "_at", "_page", "_bits", "Keep_words", "a b.c"]
    docs = spark.createDataFrame([(i, line, *[f"{n}{i}" for n in names]) for i in range(6)], ["doc_id", "text", *names])
    out = sorted(L.line_dedup(docs).collect())
    assert out[0].asDict().keys() == {"doc_id", "text", *names, "n_lines", "n_dropped"}
    assert [(r.doc_id, r.text, r.n_dropped, r._keep, r["a b.c"]) for r in out] == [(i, "" if i < 5 else line, int(i < 5), f"_keep{i}", f"a b.c{i}") for i in range(6)]


def test_empty_table_and_bitmaps(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_dedup(frame).count() == 0
    line = "another line that is long enough to be counted"
    docs = spark.createDataFrame([(i, "\n".join(["s"] * 70 + [line] + ["s"] * 5)) for i in range(5)], "doc_id long, text string")
    maps = {r.doc_id: (r.keep_words, r.n_dropped) for r in L.keep_bitmaps(docs).collect()}
    assert maps == {i: ({1: ~(1 << 6)}, 1) for i in range(4)}


def test_query_digest(spark):
    rows = L.op5_line_dedup(spark, "/root/testdata/sf0.001").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want
