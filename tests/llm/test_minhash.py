import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import minhash as M
from tidelog.llm.components import connected_components
from tidelog.llm.textkit import NOT_BLANK, Words, shingles


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent):
    own = [sets(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= percent * len(own[i] | own[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(own[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def family(seed, n_bases=6, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    bases = [[word() for _ in range(rng.choice([1, 3, 5, 40, 120]))] for _ in range(n_bases)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs[:0] = [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, "a b c")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "percent", "block"), [(1, 85, 256), (2, 80, 256), (3, 85, 4)])
def test_matches_brute_force(spark, monkeypatch, seed, percent, block):
    monkeypatch.setattr(M, "BLOCK", block)
    docs = family(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in M.near_duplicates(frame, percent).collect())
    assert got == brute(docs, percent)


def test_repeated_rows_empty_table_and_deduplicate(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1), (2, "a b c d e f", 1), (1, "A b c d e f", 2), (3, None, 3), (None, "x", 4)], "doc_id long, text string, f1 long")
    rows = sorted((tuple(r) for r in M.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(2, 2, 1), (2, 2, 1), (1, 2, 1), (3, 0, 3), (None, 1, None)], key=str)
    assert sorted(((r.doc_id, r.f1) for r in M.deduplicate(docs).collect()), key=str) == sorted([(1, 2), (3, 3), (None, 4)], key=str)
    assert M.near_duplicates(docs.filter("false")).count() == 0


def test_rows_of_one_document_with_different_texts(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(f"v{i}" for i in range(60)), " ".join(words)
    docs = spark.createDataFrame([(5, a), (5, b), (5, ""), (7, b + " z"), (9, a + " z"), (9, None), (11, "alone")], "doc_id long, text string")
    got = sorted(tuple(r) for r in M.near_duplicates(docs).collect())
    assert got == sorted([(5, 56, 5), (5, 56, 5), (5, 0, 5), (7, 57, 5), (9, 57, 5), (9, 0, 5), (11, 1, 11)])
    assert sorted((r.doc_id, r.text) for r in M.deduplicate(docs).collect()) == [(5, ""), (11, "alone")]


def test_large_bucket_of_alike_documents(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i in range(300) for k in [rng.randrange(400)]]
    docs += [(1000 + i, " ".join([*base[:300], *[f"y{i}_{j}" for j in range(100)]])) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in M.near_duplicates(frame, 85).collect()) == brute(docs, 85)


def test_comparisons_of_alike_members_grow_with_their_number(monkeypatch):
    compared = []
    real = M.staying_pairs
    monkeypatch.setattr(M, "staying_pairs", lambda s, left, right, needed: (compared.append(len(left)), real(s, left, right, needed))[1])
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, M.HASHES, dtype=np.uint8)
    per_member = []
    for n in (2048, 50_000):
        changed = np.where(rng.random((n, M.HASHES)) < 0.03, rng.integers(0, 256, (n, M.HASHES), dtype=np.uint8), base)
        marks = rng.integers(0, 256, (n, 4 * M.BANDS), dtype=np.uint8)
        signature = np.concatenate([changed, marks], axis=1)
        zeros = np.zeros(n, dtype=np.int32)
        rows = pa.table({"node": np.arange(n), "label": np.arange(n), "band": zeros, "side": zeros, "minor": zeros > 0, "many": zeros == 0, "signature": [r.tobytes() for r in signature]})
        compared.clear()
        own = M._Members(rows)
        pairs = own.within([*range(0, n, M.BLOCK), n], M.least_matches(85), int(M.HASHES * 0.88))
        assert len(own.forest(*pairs)) == n - -(-n // M.BLOCK)
        per_member.append(sum(compared) / n)
    assert per_member[1] < 1.3 * per_member[0] and per_member[1] < 3


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}
    for _ in range(250):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in up.items() if k in got} == got and set(up) - set(got) <= loops


def test_minima_estimate_the_similarity():
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join([*words[:360], *[f"v{i}" for i in range(40)]])
    rows, values = shingles(Words(pa.array([a, b]), NOT_BLANK), 5)
    _, low = M.set_minima(rows, values, 2)
    x, y = sets(a), sets(b)
    assert abs((low[:, 0] == low[:, 1]).mean() - len(x & y) / len(x | y)) < 0.06


def test_pruning_bound():
    needed = M.least_matches(85)
    rng = np.random.default_rng(1)
    equal = (rng.random((4000, M.HASHES)) < 0.86).cumsum(axis=1)[:, M.BATCH - 1 :: M.BATCH]
    assert (equal >= np.array(needed)).all(axis=1).mean() > 0.999
    assert needed[-1] > 0.75 * M.HASHES
