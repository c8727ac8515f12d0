import math
import random
import re
import time
from collections import Counter

import pyarrow as pa

from tidelog.llm import licenses as S

SCHEMA = "path string, text string, own_dir int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(files):
    n, vocabulary = len(files), {w for _, t in S.TEMPLATES for w in words(t)}
    df = Counter(w for _, t in files for w in set(words(t)) & vocabulary)
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in vocabulary else min(1, n)))) + 1

    def cosine(a, b):
        x, y = ({w: k * idf(w) for w, k in Counter(words(t)).items()} for t in (a, b))
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / size if size else 0.0

    own = []
    for path, text in files:
        lines = (text or "").split("\n")
        segments = [text or ""] if path and re.search(S.LICENCE_FILE, path) else []
        for k, line in enumerate(lines):
            i = j = k
            while i and words(lines[i - 1]):
                i -= 1
            while j + 1 < len(lines) and words(lines[j + 1]):
                j += 1
            segments += [line, "\n".join(lines[i : j + 1])] if words(line) else []
        found = [(round(cosine(s, t), 12), name) for s in segments for name, t in S.TEMPLATES]
        best = min(found, key=lambda x: (x[1] == S.RESERVED or x[0] < S.MIN_COSINE, -x[0], x[1]), default=(0.0, ""))
        own.append(best if best[0] >= S.MIN_COSINE else (0.0, None))
    out = []
    for (path, _), (score, name) in zip(files, own, strict=True):
        found = (path, name, "own", path) if name else None
        at = None if path is None else re.sub(r"/?[^/]*$", "", path)
        while found is None and at is not None:
            givers = [(-s, p, x) for (p, _), (s, x) in zip(files, own, strict=True) if x and p and re.search(S.LICENCE_FILE, p) and re.sub(r"/?[^/]*$", "", p) == at]
            if givers:
                found = (path, min(givers)[2], "inherited", min(givers)[1])
            at = None if at == "" else re.sub(r"/?[^/]*$", "", at)
        out.append((*(found or (path, None, "none", None)), round(score, 9)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice(["alpha", "license", "über", "x1", "the", "of"]) for _ in range(n))
    files = [("LICENSE", "Released under the MIT License."), ("a/COPYING.txt", dict(S.TEMPLATES)["GPL-3.0-only"]), ("a/b/LICENCE-2", "nothing to see"), (None, None), ("a/b/c", ""), ("z/LICENSE", "Licensed under CC BY-NC 4.0.")]
    for i in range(60):
        parts = [filler(rng.randint(0, 12)) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, len(parts)), rng.choice(S.TEMPLATES)[1].replace(", ", rng.choice([", ", ",\n"])))
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), "")
        folder = rng.choice(["", "a/", "a/b/", "a/b/c/", "q/", "z/y/"])
        files.append((folder + rng.choice([f"f{i}.c", f"LICENSE.{i}"]), "\n".join(parts)))
    frame = spark.createDataFrame([(*f, 1) for f in files], SCHEMA)
    rows = sorted(((r.path, r.licence, r.found, r.from_path, round(r.score, 9)) for r in S.scan(frame).collect()), key=str)
    assert rows == brute(files)


def test_notices_without_usual_words_and_whole_licences(spark):
    mit = next(t for n, t in S.TEMPLATES if n == "MIT" and "WARRANTY" in t)
    files = [
        ("a/x", "intro\nThis work is available under the Creative Commons Attribution 4.0 International.\nend"),
        ("b/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit.replace(". ", ".\n\n")),
        ("b/y", "nothing"),
    ]
    rows = {r.path: (r.licence, r.found) for r in S.scan(spark.createDataFrame([(*f, 1) for f in files], SCHEMA)).collect()}
    assert rows == {"a/x": ("CC-BY-4.0", "own"), "b/LICENSE": ("MIT", "own"), "b/y": ("MIT", "inherited")}


def test_columns_with_the_names_used_inside(spark):
    names = ["_whole", "_own_dir", "_dir", "_licence", "_from", "_at"]
    frame = spark.createDataFrame([("d/LICENSE", "Released under the MIT License.", *names), ("d/x", None, *names)], ["path", "text", *names])
    rows = {r.path: r for r in S.scan(frame).collect()}
    assert rows["d/x"].licence == "MIT" and all(r[n] == n for r in rows.values() for n in names)


def test_time_grows_with_the_lines():
    scanner = S.Scanner(S.Templates(10, {}))
    times = []
    for n in (20_000, 100_000):
        text = "licensed words in a line of text\n" * n
        began = time.perf_counter()
        scanner.own(pa.array([text]), [False])
        times.append(time.perf_counter() - began)
    assert times[1] < 12 * times[0]


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([("d/x", "Released under the MIT License.", 1)] * 2, SCHEMA)
    assert [(r.licence, r.found) for r in S.scan(frame).collect()] == [("MIT", "own")] * 2
    assert S.scan(frame.filter("false")).count() == 0


def test_documents_of_a_given_table_inherit(spark):
    rows = S.op6_license_scan(spark, "/root/testdata/sf0.001").collect()
    found = Counter(r.found for r in rows)
    assert found["own"] and found["inherited"] and found["none"]
    givers = {r.path: r.own_licence for r in rows if re.search(S.LICENCE_FILE, r.path) and r.own_licence}
    for r in rows:
        if r.found == "inherited":
            assert givers[r.from_path] == r.licence and r.from_path.rsplit("/", 1)[0] == r.path.rsplit("/", 1)[0]


def test_reserved_rights_are_an_own_result(spark):
    files = [
        ("d/LICENSE", "Released under the MIT License."),
        ("d/x", "some text\nAll rights reserved."),
        ("d/y", "some text"),
        ("d/z", "Copyright 2020 A. All rights reserved.\n\nAll rights reserved.\n\n" + dict(S.TEMPLATES)["BSD-3-Clause"]),
        ("d/m", "All rights reserved.\nReleased under MIT License."),
    ]
    rows = {r.path: (r.licence, r.found) for r in S.scan(spark.createDataFrame([(*f, 1) for f in files], SCHEMA)).collect()}
    assert rows["d/x"] == (S.RESERVED, "own") and rows["d/y"] == ("MIT", "inherited")
    assert rows["d/z"] == ("BSD-3-Clause", "own") and rows["d/m"] == ("MIT", "own")
    documents = S.op6_license_scan(spark, "/root/testdata/sf0.001").filter("own_licence is not null")
    assert Counter(r.own_licence for r in documents.collect())[S.RESERVED] == 3
