import random

from pyspark.sql import functions as F

from tidelog.llm import warc as W

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"


def brute(rows):
    out = []
    canon = lambda u: None if u is None else u.split("://")[1].split("#")[0].rstrip("/")
    for i, url, ts, kind, tag, lm, headers in rows:
        if kind != "revisit":
            continue
        if url is None or ts is None:
            out.append((i, None, "no url or time", headers or {}))
            continue
        older = [r for r in rows if r[3] == "response" and r[1] is not None and r[2] is not None and canon(r[1]) == canon(url) and r[2] < ts]
        if not older:
            out.append((i, None, "no earlier response", headers or {}))
            continue
        r = max(older, key=lambda r: (r[2], r[0]))
        weak = lambda t: t.removeprefix("W/")
        ok = weak(tag) == weak(r[4]) if tag and r[4] else lm == r[5] if lm and r[5] else None
        merged = {**(r[6] or {}), **{k: v for k, v in (headers or {}).items() if k in W.UPDATABLE}}
        out.append((i, r[0], "resolved", merged) if ok else (i, None, "no validator" if ok is None else "modified", headers or {}))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        url = rng.choice([None, "http://a.org/x", "https://a.org/x/", "http://a.org/x#f", "http://b.org/y"])
        rows.append((i, url, rng.choice([None, *range(60)]), rng.choice(["response", "revisit"]), rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "m1", "m2"]), rng.choice([None, {"etag": str(i), "content-type": "t"}, {"date": str(i), "content-length": "0"}])))
    for blocks in (1, 7, 64):
        got = W.resolve_revisits(spark.createDataFrame(rows, SCHEMA), blocks).collect()
        assert sorted(((r.record_id, r.refers_to, r.outcome, dict(r.headers)) for r in got), key=str) == [tuple(x) for x in brute(rows)]


def test_canonical(spark):
    urls = ["http://www.A.org:80/b/?utm_source=x&z=1&a=2#f", "https://a.org/b?a=2&z=1", "a.org/b", None, "http://", "http://a.org/?ref=x", "http://a.org:443/", "https://a.org:443/", "https://a.org:80"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(W.canonical_url(F.col("url"))).collect()]
    assert got == ["a.org/b?a=2&z=1", "a.org/b?a=2&z=1", None, None, "", "a.org?ref=x", "a.org:443", "a.org", "a.org:80"]


def test_repeated_and_empty(spark):
    rows = [(1, "http://a/x", 1, "response", "t", None, None), (2, "http://a/x", 2, "revisit", "t", None, None), (2, "http://a/x", 2, "revisit", "t", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x"))
    assert [r.refers_to for r in W.resolve_revisits(frame).collect()] == [1, 1]
    assert W.resolve_revisits(frame.filter("false")).count() == 0
