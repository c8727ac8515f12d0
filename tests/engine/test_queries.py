"""Every query with SQL against DuckDB, at the smallest scale; the streams against their batch views."""

import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidelog.functions.text import normalize
from tidelog.plans.catalogue import QUERIES, SQL, event_log
from tidelog.sources.tables import compact, export_tsv

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return str(value) if isinstance(value, (datetime.date, bytearray, bytes)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, names = [tuple(r) for r in df.collect()], sorted(df.columns)
    if name not in SQL:
        assert rows
        return
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    sort = lambda rows, columns: sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in rows), key=str)
    assert sort(rows, df.columns) == sort(cur.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice"]
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_stream_passes_rows_on_once(spark, tmp_path):
    from tidelog.streaming.watch import deduplicated, stream_log

    rows = spark.read.parquet(f"{SF}/events.parquet")
    for _ in range(2):
        rows.write.mode("append").parquet(f"{tmp_path}/log")
    out = deduplicated(stream_log(spark, f"{tmp_path}/log", 10), "60 days")
    q = out.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == rows.count() == event_log(spark, SF).count()


def test_export_and_compact(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id long, v string")
    export_tsv(rows, f"{tmp_path}/t", ["v", "id"])
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/t", sep="\t").collect()} == {("a", "1"), ("b", "2")}
    compact(rows, f"{tmp_path}/c", ["id"])
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2


def test_whole_texts_are_searched(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r.text for r in QUERIES["normalize"](spark, SF).collect()}
    assert max(map(len, found.values())) > 60 and {k: len(v.split()) for k, v in found.items()} == {k: len(v.split()) for k, v in docs.items()}
    pad = "\U0010ffff" * 2
    windows = {k: len({f"{pad}{v}{pad}"[i : i + 3] for i in range(len(v) + 2)}) for k, v in found.items()}
    assert {r.doc_id: r.n_grams for r in QUERIES["gram_count"](spark, SF).collect()} == windows
    grams = lambda v: {f"{pad}{v}{pad}"[i : i + 3] for i in range(len(v) + 2)}
    lines = spark.createDataFrame([(k, n, line) for k, v in docs.items() for n, line in enumerate(v.split("\n"))], "doc_id long, at int, line string")
    lines = [(r.doc_id, r.at, grams(r.line)) for r in lines.withColumn("line", normalize(F.col("line"))).collect()]
    want, late = [], 0
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("text", normalize(F.col("text"))).collect():
        own, best = grams(item.text), {}
        for doc, at, g in lines:
            both = len(own & g)
            best[doc] = max(best.get(doc, (0, 0)), (both / (len(own) + len(g) - both), at))
        top = sorted((-s, doc, at) for doc, (s, at) in best.items() if s >= 0.25)[:3]
        want += [(item.item_id, doc, round(-s, 9), n) for n, (s, doc, _) in enumerate(top, 1)]
        late += sum(at > 0 for _, _, at in top)
    assert late and sorted(tuple(r) for r in QUERIES["fuzzy_batch"](spark, SF).collect()) == sorted(want)


def test_all_customers_are_asked_to_be_removed(spark):
    larger = SF.replace("sf0.001", "sf0.01")
    asked = {r.c_custkey for r in spark.read.parquet(f"{larger}/customer.parquet").select("c_custkey").collect()}
    assert max(asked) >= 200 and {r.id for r in QUERIES["remove_batch"](spark, larger).collect()} == asked
