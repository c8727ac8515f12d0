"""Scenarios of the record model, on small version logs."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import changes, fuzzy, log, navigate, order, setops, writes
from tidelog.operators.order import Bound
from tidelog.plans.registry import NotExposed, Registry


def frame(spark, rows, tenant=1):
    """rows: (id, op, value); the place in the list is instant and seq."""
    return spark.createDataFrame([(tenant, i, k, k, op, v) for k, (i, op, v) in enumerate(rows, 1)], "tenant long, id string, instant long, seq long, op string, value long")


def test_recency_and_removal(spark):
    rows = frame(spark, [("a", "saved", 1), ("b", "saved", 22), ("c", "saved", 3), ("a", "saved", 4), ("b", "removed", None), ("b", "removed", None), ("x", "removed", None)])
    assert [(r.id, r.value) for r in log.recency(rows).orderBy("n").collect()] == [("a", 4), ("c", 3)]
    assert {(r.id, r.value, r.removed) for r in log.get(rows).collect()} == {("a", 4, False), ("b", 22, True), ("c", 3, False)}
    assert [r.seq for r in log.effective_removals(rows).collect()] == [5]
    states = log.classify(rows, spark.createDataFrame([(1, k) for k in "abxy"], "tenant long, id string"))
    assert {r.id: r.state for r in states.collect()} == {"a": "living", "b": "dead", "x": "vacant", "y": "vacant"}
    effect = writes.removals(rows, spark.createDataFrame([(1, k) for k in "aby"], "tenant long, id string"))
    assert {r.id: r.took_effect for r in effect.collect()} == {"a": True, "b": False, "y": False}
    assert log.instant_floor(rows).first()["floor"] == 5


def test_history_links_and_revival(spark):
    rows = frame(spark, [("a", "saved", 1), ("a", "saved", 2), ("a", "removed", None), ("a", "saved", 3)])
    assert [r.value for r in log.history(rows).orderBy("n").collect()] == [3, 2, 1]
    links = {r.seq: (r.previous, r.next, r.removed) for r in log.versions(rows).collect()}
    assert links == {1: (None, 2, False), 2: (1, 4, True), 4: (2, None, False)}
    assert [r.seq for r in writes.revivals(rows).collect()] == [4]
    feed = changes.collection_changes(rows, F.lit(2)).orderBy("instant").collect()
    assert [(r.kind, r.seq) for r in feed] == [("removed", 3), ("saved", 4)]
    assert changes.cursor_after(changes.collection_changes(rows, F.lit(9)), F.lit(9)).first()["cursor"] == 9
    assert [r.value for r in log.as_of(rows, F.lit(2)).collect()] == [2] and log.as_of(rows, F.lit(3)).count() == 0


def test_saved_then_removed_is_one_removal(spark):
    rows = frame(spark, [("a", "saved", 1), ("a", "saved", 2), ("a", "removed", None)])
    assert [(r.kind, r.seq) for r in changes.collection_changes(rows, F.lit(0)).collect()] == [("removed", 3)]


@pytest.mark.parametrize(("cursor", "want"), [(1, [2, 3]), (3, []), (-1, [3]), (99, [])])
def test_unique_changes(spark, cursor, want):
    rows = frame(spark, [("u", "saved", 10), ("u", "saved", 20), ("u", "saved", 30)])
    since = spark.createDataFrame([(1, "u", cursor)], "tenant long, id string, since_seq long")
    assert sorted(r.seq for r in changes.unique_changes(rows, since).collect()) == want


def people(spark):
    return spark.createDataFrame([(1, "carol", "lisboa"), (2, "alice", "porto"), (3, "bob", "lisboa"), (4, "dave", "faro")], "id long, name string, city string")


def test_bounds(spark):
    rows = people(spark)
    names = lambda bound, *fields: sorted(r.name for r in order.by(rows, list(fields), bound).collect())
    assert names(Bound.between("b", "d"), "name") == ["bob", "carol"]
    assert names(Bound.between(("lisboa", ""), ("lisboa", "\x7f")), "city", "name") == ["bob", "carol"]
    assert names(Bound.exact("lisboa", "bob"), "city", "name") == ["bob"]
    assert names(Bound.prefix("lis"), "city") == ["bob", "carol"]
    assert names(Bound.prefix("lisboa", "b"), "city", "name") == ["bob"]
    assert len(names(Bound(), "name")) == 4


def test_lists_pages_and_ranks(spark):
    rows, by = people(spark), [F.asc("city"), F.asc("name")]
    assert [r.name for r in order.listed(rows, by).collect()] == ["dave", "bob", "carol", "alice"]
    assert [r.name for r in order.listed(rows, by, 1, 2).collect()] == ["bob", "carol"]
    assert order.listed(rows, by, 9).count() == 0 and order.listed(rows, by, 0, 0).count() == 0
    assert {r.name: r.n for r in order.ranked(rows, by).collect()} == {"dave": 1, "bob": 2, "carol": 3, "alice": 4}
    many = spark.range(20000).select(((F.col("id") * 7919) % 20011).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    numbered = order.ranked(many, [F.asc("k")])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_key = [r.n for r in numbered.orderBy("k").select("n").collect()]
    assert by_key == list(range(1, 20001))
    assert tuple(order.last_key(rows, ["city", "name"]).first()) == ("porto", "alice")


def test_set_algebra(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = lambda f: sorted(r.id for r in f.collect())
    left, right = ids(1, 2, 2, 3), ids(2, 4, 2)
    assert got(setops.intersect(left, right, "id")) == [2, 2]
    assert got(setops.except_(left, right, "id")) == [1, 3]
    assert got(setops.union(left, right, "id")) == [1, 2, 3, 4]


def test_guards_and_batches(spark):
    rows = frame(spark, [("a", "saved", 1), ("b", "saved", 2)])
    guard = lambda seq: spark.createDataFrame([(1, "a", seq)], "tenant long, id string, expected long")
    more = rows.withColumn("instant", F.col("instant") + 10)
    assert writes.conflicts(rows, guard(1)).count() == 0 and writes.conflicts(rows, guard(7)).first().actual == 1
    assert writes.guarded_batch(rows, more, guard(1)).count() == 4 and writes.guarded_batch(rows, more, guard(7)).count() == 2
    assert writes.adopt(rows, rows.union(more)).count() == 4
    assert [r.seq for r in writes.missing(rows, F.col("value") == 1).collect()] == [2]


def test_overlay(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    staged = spark.createDataFrame([(2, "B", False), (3, "c", True), (4, "d", False)], "id long, v string, gone boolean")
    assert sorted(map(tuple, writes.overlay(base, staged, ["id"]).collect())) == [(1, "a"), (2, "B"), (4, "d")]


def test_fuzzy_modes(spark):
    rows = spark.createDataFrame([(1, "sitting"), (2, "Kitten"), (3, "b"), (4, None), (5, "kittens")], "id long, name string")
    found = lambda q, mode, x, **k: [r.id for r in fuzzy.fuzzy_search(rows, "name", q, mode, x, 10, "id", **k).collect()]
    assert found("kitten", "distance", 3) == [2, 5, 1] and found("kitten", "distance", 2) == [2, 5]
    assert found("a", "distance", 1) == [3] and found("a", "distance", 1, exact=False) == []
    assert found("kitten", "similarity", 0.5) == [2, 5]
    assert found("kit", "contains", 0.6) == [2, 5]
    with pytest.raises(ValueError, match="mode"):
        found("a", "other", 1)


def test_fuzzy_batch_loses_nothing(spark):
    import random

    rng = random.Random(4)
    made = lambda n: [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12)))) for i in range(n)]
    q, r = (spark.createDataFrame(made(n), s) for n, s in ((15, "q long, t string"), (80, "r long, t string")))
    got = {(x.q, x.r) for x in fuzzy.fuzzy_batch(q, r, ("q", "t"), ("r", "t"), 0.3, 1000).collect()}
    from tidelog.functions.text import grams, jaccard, normalize

    both = q.toDF("q", "a").crossJoin(r.toDF("r", "b")).filter(jaccard(grams(normalize(F.col("a"))), grams(normalize(F.col("b")))) >= 0.3)
    assert got == {(x.q, x.r) for x in both.collect()} and got


def _windows(text, n):
    padded = "\U0010ffff" * (n - 1) + text + "\U0010ffff" * (n - 1)
    return {padded[i : i + n] for i in range(len(padded) - n + 1)}


def _best(queries, rows, amount, limit, n):
    """(query, record, score, place) by comparing all sets."""
    asked, met, out = [(i, _windows(t, n)) for i, t in queries if t is not None], [(i, _windows(t, n)) for i, t in rows if t is not None], []
    for q in {i for i, _ in asked}:
        found = {}
        for own in (g for i, g in asked if i == q):
            for r, g in met:
                if own & g and len(own & g) / len(own | g) >= amount:
                    found[r] = max(found.get(r, 0), len(own & g) / len(own | g))
        out += [(q, r, s, k) for k, (r, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:limit], 1)]
    return sorted(out)


def _shuffled(spark):
    """Rows written to shuffles so far, by stages that are still known."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, none, None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_fuzzy_batch_shuffles_neither_texts_nor_pairs(spark):
    texts = [(i, f"the same words of all lines {i % 1500} {i % 7}") for i in range(3000)]
    queries = [(i, f"the same words of all lines {i}") for i in range(20)]
    q, r = spark.createDataFrame(queries, "q long, t string"), spark.createDataFrame(texts, "r long, t string")
    before = _shuffled(spark)
    got = sorted(tuple(x) for x in fuzzy.fuzzy_batch(q, r, ("q", "t"), ("r", "t"), 0.25, 3).collect())
    after = _shuffled(spark)
    assert got == _best(queries, texts, 0.25, 3, 3) and len(got) == 60
    # less than one row a text, where each of 60 000 pairs is similar enough
    assert sum(v for k, v in after.items() if k not in before) < len(texts)


@pytest.mark.parametrize("kind", ["long", "string", "struct<a:long,b:string>"])
def test_fuzzy_batch_by_several_indexes_ties_and_kinds_of_ids(spark, monkeypatch, kind):
    import random

    from tidelog.functions import overlap

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc \U0001f30a\U0010ffff漢") for _ in range(rng.randint(0, 9)))
    clean = lambda t: " ".join(t.split())
    named = {"long": lambda i: i - 20, "string": lambda i: f"é{i}" if i % 3 else f"{i}"}.get(kind, lambda i: (i % 3, f"{i}"))
    queries = [(i // 2, clean(word())) for i in range(14)] + [(99, None), (98, "")]
    rows = [(named(i // 3), clean(word())) for i in range(120)] + [(named(i), "abc") for i in range(60, 90)] + [(named(0), None)]
    q, r = spark.createDataFrame(queries, "q long, t string"), spark.createDataFrame(rows, f"r {kind}, t string").repartition(3)
    monkeypatch.setattr(overlap, "CELLS", 150)
    assert len(list(overlap.indexes([x for x in queries if x[1] is not None], 3, overlap.CELLS))) > 2
    for amount, limit in ((0.2, 3), (0.0, 7)):
        got = fuzzy.fuzzy_batch(q, r, ("q", "t"), ("r", "t"), amount, limit).collect()
        assert sorted((x.q, tuple(x.r) if "struct" in kind else x.r, x.score, x.n) for x in got) == _best(queries, rows, amount, limit, 3)
    assert fuzzy.fuzzy_batch(q.filter("t is null"), r, ("q", "t"), ("r", "t"), 0.2, 3).collect() == []


@pytest.mark.parametrize("n", [2, 3, 5])
def test_overlaps_of_any_slices_and_letters(monkeypatch, n):
    import random

    import pyarrow as pa

    from tidelog.functions import overlap

    rng = random.Random(n)
    # so many letters that windows of five have to be numbered anew
    letters = [chr(0x4E00 + i) for i in range(20_000)]
    part = lambda: "".join(rng.choices(letters, k=rng.randint(0, 12)))
    parts = [part() for _ in range(12)]
    made = lambda k: [(i, "".join(rng.choices(parts, k=rng.randint(0, 4)))) for i in range(k)]
    queries, rows = made(9), made(400) + [(400, "".join(letters))]
    # the counts of this one do not fit in 16 bits
    queries.append((9, "".join(rng.choices(letters, k=70_000))))
    rows.append((401, queries[-1][1]))
    for slices in (1, 1 << 18):
        monkeypatch.setattr(overlap, "LETTERS", slices)
        monkeypatch.setattr(overlap, "COUNTS", 40 * slices)
        for chosen in (queries[:9], queries):
            (index,) = overlap.indexes(chosen, n, 1 << 30)
            best, got = overlap.Best(index, n, 0.1, 4), []
            for k in range(0, len(rows), 150):
                i, t = zip(*rows[k : k + 150])
                found = best.of(pa.array(i), pa.array(t))
                got += zip(found[0].tolist(), found[1].to_pylist(), found[2].tolist())
            top = []
            for q, _ in chosen:
                top += [(q, r, s, m) for m, (s, r) in enumerate(sorted(((s, r) for x, r, s in got if x == q), key=lambda x: (-x[0], x[1]))[:4], 1)]
            assert sorted(top) == _best(chosen, rows, 0.1, 4, n) and top
            assert len(got) <= 4 * len(chosen) * 3


def test_navigation(spark):
    holders = spark.createDataFrame([(1, 10), (2, 20)], "id long, pivot long")
    children = spark.createDataFrame([(10, 5), (10, 4), (30, 6)], "owner long, n long")
    assert sorted(r.n for r in navigate.follow(holders, children, "pivot", "owner").collect()) == [4, 5]
    nested = {r.id: [x.n for x in r["items"]] for r in navigate.nest(holders, children, "pivot", "owner", "items").collect()}
    assert nested == {1: [4, 5], 2: []}


def test_registry():
    r = Registry(never={"shut"})

    @r.expose
    def double(x):
        return 2 * x

    @r.expose(public=True)
    def nothing(x):
        return None

    r.functions["shut"] = double
    assert r.call("double", 3) == 6 and r.call("nothing", 1, login=False, fallback=lambda x: x + 1) == 2
    for name, login in (("double", False), ("shut", True), ("unknown", True)):
        with pytest.raises(NotExposed):
            r.call(name, 1, login=login)
    assert r.identity("double") != r.identity("nothing")


def test_minted_instants_rise_above_the_floor(spark):
    import random

    rng = random.Random(1)
    clocks = [rng.randrange(60) for _ in range(40)]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(clocks)], "tenant long, n long, clock long")
    got = [r.instant for r in writes.mint_instants(rows, "clock", ["n"], F.lit(12).cast("long")).orderBy("n").collect()]
    last, want = 12, []
    for c in clocks:
        last = max(c, last + 1)
        want.append(last)
    assert got == want


def test_poll(spark):
    rows = frame(spark, [("a", "saved", 1), ("b", "saved", 2), ("a", "removed", None)]).union(frame(spark, [("c", "saved", 5)], 2))
    topics = spark.createDataFrame([(1, 2), (2, None), (3, 7)], "tenant long, since long")
    assert [(r.tenant, r.kind, r.id) for r in changes.poll(rows, topics).collect()] == [(1, "removed", "a")]
    assert {r.tenant: r.cursor for r in changes.poll_cursors(rows, topics).collect()} == {1: 3, 2: 1, 3: 7}


def test_an_index_entry_without_a_record_is_an_error(spark):
    from tidelog.operators.navigate import resolve

    index, records = spark.createDataFrame([(1,), (2,)], "a long"), spark.createDataFrame([(1, "x")], "k long, v string")
    assert resolve(index.filter("a = 1"), records, "a", "k").count() == 1
    for read in (lambda df: df.count(), lambda df: df.select("a").collect()):
        try:
            read(resolve(index, records, "a", "k"))
        except Exception as error:
            assert "record missing: 2" in str(error)
        else:
            raise AssertionError("no error")


def test_numbers_and_instants_of_one_large_tenant(spark):
    import random

    from tidelog.operators.order import listed, ranked
    from tidelog.operators.writes import mint_instants

    rng = random.Random(1)
    data = [(None if i % 50 == 0 else int(rng.random() < 0.1), rng.randrange(500), i) for i in range(800)]
    rows = spark.createDataFrame(data, "tenant long, clock long, i long").repartition(5)
    last, want, numbers = {}, {}, {}
    for tenant, clock, i in data:
        last[tenant] = max(clock, last.get(tenant, 100) + 1)
        numbers[tenant] = numbers.get(tenant, 0) + 1
        want[i] = (last[tenant], numbers[tenant])
    minted = mint_instants(rows, "clock", ["i"], F.lit(100).cast("long"))
    numbered = ranked(minted, [F.asc("i")], "n", within=("tenant",)).collect()
    assert {r.i: (r.instant, r.n) for r in numbered} == want
    assert [r.i for r in listed(rows, [F.desc("i")], offset=790).collect()] == list(range(9, -1, -1))


def test_a_watch_goes_on_where_it_ended(spark, tmp_path):
    import uuid

    from tidelog.streaming.watch import replay

    log = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id as event_id, id % 40 as user_id, if(id % 7 = 0, 'error', 'view') as event_type from range(600)")
    folder = str(tmp_path / "log")
    name = f"test_{uuid.uuid4().hex}"  # the checkpoint folder may outlive a run
    shown = lambda rows: sorted({r.user_id: r.event_id for r in sorted(rows.collect(), key=lambda r: r.event_id) if r.event_type != "error"}.items())
    alive = lambda rows: {r.user_id for r in rows.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).filter("last <> 'error'").collect()}
    for low, high in ((0, 300), (300, 600)):
        log.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).repartition(3).write.mode("append").parquet(folder)
        read = log.filter(F.col("event_id") < high)
        got = sorted(tuple(r) for r in replay(spark, folder, name=name).collect())
        assert got == [x for x in shown(read) if x[0] in alive(read)]


def test_census(spark, tmp_path):
    from tidelog.sources.tables import census

    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    rows = census(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len(rows) == 3 and sum(r.rows for r in rows) == 100 and all(r.bytes > 0 and r.blocks == 1 for r in rows)


def test_a_drain_stops_at_the_first_fault_of_its_owner(spark):
    from pyspark.sql import functions as F

    from tidelog.operators import navigate

    rows = [(1, 1, "ok"), (1, 2, "conflict"), (1, 3, "fault"), (1, 4, "ok"), (1, 5, "conflict"), (2, 1, "conflict"), (2, 2, "ok"), (None, 1, "ok"), (None, 2, "fault"), (3, 1, None)]
    queue = spark.createDataFrame(rows, "owner int, at int, kind string")
    got = navigate.drain(queue, "owner", ["at"], F.col("kind") == "fault", F.col("kind") == "conflict").collect()
    assert {(r.owner, r.at): r.outcome for r in got} == {
        (1, 1): "sent", (1, 2): "dropped", (1, 3): "kept", (1, 4): "kept", (1, 5): "kept",
        (2, 1): "dropped", (2, 2): "sent", (None, 1): "sent", (None, 2): "kept", (3, 1): "sent",
    }


def test_a_union_keeps_the_place_of_first_occurrences(spark):
    from pyspark.sql import functions as F

    from tidelog.operators import setops

    left = spark.createDataFrame([("c", 1), ("a", 2), ("c", 3)], "id string, at int")
    right = spark.createDataFrame([("b", 1), ("a", 2), ("d", 3), ("b", 4)], "id string, at int")
    got = setops.union_in_order(left, right, "id", F.col("at")).orderBy("n").collect()
    assert [(r.id, r.n) for r in got] == [("c", 1), ("a", 2), ("b", 3), ("d", 4)]


def test_a_token_that_comes_again_revokes_its_session(spark):
    from pyspark.sql import functions as F

    from tidelog.operators import sessions

    rows = [(1, 1, "0", True), (1, 2, "1", True), (1, 3, "9", False), (1, 4, "2", True), (1, 5, "1", True), (1, 6, "3", True), (2, 1, "1", True), (2, 2, "0", True), (3, 1, None, True), (3, 2, "0", True), (None, 1, "0", True)]
    presented = spark.createDataFrame(rows, "s int, at int, t string, ok boolean")
    got = sessions.rotate(presented, "s", ["at"], F.col("t"), lambda g: g.cast("string"), F.col("ok")).collect()
    assert {(r.s, r.at): r.outcome for r in got} == {
        (1, 1): "rotated", (1, 2): "rotated", (1, 3): "refused", (1, 4): "rotated", (1, 5): "revoked", (1, 6): "refused",
        (2, 1): "revoked", (2, 2): "refused", (3, 1): "refused", (3, 2): "rotated", (None, 1): "rotated",
    }


def test_idle_polls_back_off_to_a_ceiling():
    from tidelog.streaming.watch import polled

    waits, answers = [], iter([[], [], ["a"], [], [], [], [], [], [], ["b"]])
    got = polled(lambda: next(answers), 2.0, waits.append)
    assert [next(got), next(got)] == [["a"], ["b"]]
    assert waits == [4.0, 8.0, 2.0, 4.0, 8.0, 16.0, 32.0, 32.0, 32.0]
