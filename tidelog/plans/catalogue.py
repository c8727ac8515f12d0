"""Catalogue of the engine's named queries over the driver's tables.

``QUERIES`` has callables of (spark, sf_dir); ``SQL`` the same in DuckDB's SQL. The
events table plays the version log: user_id is the record, user_id % 16 its tenant,
ts the instant, event_id the order number, and an ``error`` removes the record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import hashing, ids, text, tokens
from tidelog.operators import changes, fuzzy, log, navigate, order, sessions, setops, writes
from tidelog.operators.order import Bound
from tidelog.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def event_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        (F.col("user_id") % 16).alias("tenant"),
        F.col("user_id").alias("id"),
        F.col("ts").alias("instant"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "removed").otherwise("saved").alias("op"),
        "event_type",
        "value",
    )


# the same log, and views over it, for the SQL side
LOG = """
log AS (SELECT user_id % 16 AS tenant, user_id AS id, ts AS instant, event_id AS seq,
               CASE WHEN event_type = 'error' THEN 'removed' ELSE 'saved' END AS op, event_type, value FROM events),
seen AS (SELECT *, lag(op) OVER w AS before, lead(op) OVER w AS after FROM log WINDOW w AS (PARTITION BY tenant, id ORDER BY instant, seq)),
last_saved AS (SELECT * FROM log WHERE op = 'saved' QUALIFY row_number() OVER (PARTITION BY tenant, id ORDER BY instant DESC, seq DESC) = 1),
last_row AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY tenant, id ORDER BY instant DESC, seq DESC) = 1),
got AS (SELECT s.*, r.op = 'removed' AS removed FROM last_saved s JOIN last_row r ON s.tenant = r.tenant AND s.id = r.id),
live AS (SELECT * FROM got WHERE NOT removed),
dead AS (SELECT * FROM seen WHERE op = 'removed' AND before = 'saved')
"""
#: The secrets of the token queries; the second one signs what must be refused.
SECRETS = (b"a secret of the node", b"a secret of another node, longer than a block of the hash: it is hashed before it pads the message")


def mac_sql(message: str, secret: bytes) -> str:
    inner, outer = (p.hex() for p in tokens.pads(secret))
    return f"unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message}))))"


def little_endian_sql(value: str, width: int) -> str:
    return "(" + " || ".join(f"substr(printf('%016X', {value}), {15 - 2 * k}, 2)" for k in range(width)) + ")"


def seahash_sql(key: str, digits: str, source: str, select: str) -> str:
    """SQL of the hash of each row's bytes, given as hex digits: ``h`` unsigned, ``signed`` the same bits as a long."""
    mask, times = "18446744073709551615::UHUGEINT", f"{hashing.MULTIPLIER}::UHUGEINT"
    word = " || ".join(f"substr(w, {15 - 2 * k}, 2)" for k in range(8))
    mixed = f"((xor(y, (y >> 32::UHUGEINT) >> (y >> 60::UHUGEINT)) * {times}) & {mask})"
    start = ", ".join(f"{v}::UHUGEINT" for v in hashing.SEEDS)
    return f"""WITH RECURSIVE keys AS (SELECT {key} AS k, {digits} AS x FROM {source}),
lanes(k, x, i, a, b, c, d) AS (
  SELECT k, x, 0, {start} FROM keys
  UNION ALL
  SELECT k, x, i + 1, b, c, d, {mixed}
  FROM (SELECT *, (xor(a, ('0x' || {word})::UBIGINT::UHUGEINT) * {times}) & {mask} AS y
        FROM (SELECT *, rpad(substr(x, 16 * i + 1, 16), 16, '0') AS w FROM lanes WHERE 16 * i < length(x)))),
hashed AS (
  SELECT k, {mixed} AS h
  FROM (SELECT k, (xor(xor(xor(xor(a, b), c), d), (length(x) // 2)::UHUGEINT) * {times}) & {mask} AS y FROM lanes WHERE 16 * i >= length(x))),
hashes AS (SELECT k, h, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS signed FROM hashed)
{select}"""


def wire_sql(value: str) -> str:
    return f"({little_endian_sql(f'strlen({value})', 4)} || hex(encode({value})))"


T0 = "timestamp_ntz'2024-01-20 00:00:00'"


# scans and sources


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42")
def unique_get(spark, d):
    return order.by(table(spark, d, "customer"), ["c_custkey"], Bound.exact(42))


@query(f"WITH {LOG} SELECT tenant, id, seq, value, removed FROM got")
def record_get_including_removed(spark, d):
    return log.get(event_log(spark, d)).select("tenant", "id", "seq", "value", "removed")


@query("""SELECT o_orderkey, (o_custkey = 10) AS member, CASE WHEN o_custkey = 10 THEN o_totalprice END AS o_totalprice
FROM orders WHERE o_custkey IN (10, 11, 12)""")
def member_get(spark, d):
    rows = table(spark, d, "orders").filter(F.col("o_custkey").isin(10, 11, 12))
    return navigate.member_values(rows, F.col("o_custkey") == 10, ["o_totalprice"]).select("o_orderkey", "member", "o_totalprice")


@query(f"""WITH {LOG}, ids AS (SELECT c_custkey % 16 AS tenant, c_custkey AS id FROM customer)
SELECT i.tenant, i.id, CASE WHEN g.id IS NULL THEN 'vacant' WHEN g.removed THEN 'dead' ELSE 'living' END AS state
FROM ids i LEFT JOIN got g ON g.tenant = i.tenant AND g.id = i.id""")
def anchor_classify(spark, d):
    asked = table(spark, d, "customer").select((F.col("c_custkey") % 16).alias("tenant"), F.col("c_custkey").alias("id"))
    return log.classify(event_log(spark, d), asked)


@query(f"WITH {LOG} SELECT tenant, id, seq, row_number() OVER (PARTITION BY tenant ORDER BY instant DESC, seq DESC) AS n FROM live")
def all_recency(spark, d):
    return log.recency(event_log(spark, d)).select("tenant", "id", "seq", F.col("n").cast("long").alias("n"))


@query(f"""WITH {LOG}, v AS (SELECT *, lag(seq) OVER (PARTITION BY tenant, id ORDER BY instant, seq) AS previous FROM log WHERE op = 'saved')
SELECT l.tenant, l.id, l.seq, v.previous, l.event_type, l.value FROM live l JOIN v ON v.seq = l.seq""")
def all_values(spark, d):
    rows = event_log(spark, d)
    links = log.versions(rows).filter("next is null and not removed")
    return links.select("tenant", "id", "seq", "previous", "event_type", "value")


@query(f"WITH {LOG} SELECT count(*) AS n FROM live")
def living_count(spark, d):
    return log.live(event_log(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT tenant, count(*) AS n FROM live GROUP BY tenant")
def list_len_by_tenant(spark, d):
    return log.live(event_log(spark, d)).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG}, took AS (SELECT tenant, instant, seq FROM log WHERE op = 'saved' UNION ALL SELECT tenant, instant, seq FROM dead)
SELECT tenant, arg_max(seq, instant) AS floor FROM took GROUP BY tenant""")
def instant_floor(spark, d):
    return log.instant_floor(event_log(spark, d))


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")



def _by_date():
    return [F.asc("o_orderdate"), F.asc("o_orderkey")]


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderdate >= '1998-01-01'""")
def scan_from(spark, d):
    rows = _orders(spark, d).filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    return order.ranked(rows, _by_date()).select("o_orderkey", F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 900")
def scan_skip(spark, d):
    return order.listed(_orders(spark, d), _by_date(), offset=900).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def scan_back(spark, d):
    return order.listed(_orders(spark, d), [F.desc("o_orderdate"), F.desc("o_orderkey")], limit=25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders) ORDER BY o_orderkey DESC LIMIT 1")
def last_key(spark, d):
    return order.last_key(_orders(spark, d), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 77 AND p_name >= 'a'")
def entry_get(spark, d):
    return order.by(table(spark, d, "part"), ["p_partkey"], Bound.exact(77)).filter("p_name >= 'a'").select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
def range_count(spark, d):
    return order.by(_orders(spark, d), ["o_totalprice"], Bound.between(100000.0, 150000.0)).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000
ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20 OFFSET 5""")
def span_read(spark, d):
    rows = order.by(_orders(spark, d), ["o_totalprice"], Bound.between(100000.0, 150000.0))
    return order.listed(rows, [F.desc("o_totalprice"), F.desc("o_orderkey")], 5, 20).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE o_orderpriority <> '1-URGENT'""")
def overlay_scan(spark, d):
    base = _orders(spark, d).select("o_orderkey", "o_totalprice")
    puts = _orders(spark, d).filter("o_orderpriority = '2-HIGH'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(False).alias("gone"))
    gone = _orders(spark, d).filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice", F.lit(True).alias("gone"))
    return writes.overlay(base, puts.union(gone), ["o_orderkey"])


# writes


@query(f"WITH {LOG} SELECT tenant, arg_max(seq, instant) AS seq, arg_max(value, instant) AS value, count(*) AS n_saved FROM log WHERE op = 'saved' GROUP BY tenant")
def unique_upsert_latest(spark, d):
    rows = event_log(spark, d).drop("id")
    return writes.upsert(rows, ["tenant"]).select("tenant", "seq", "value", "n_saved")


@query(f"WITH {LOG} SELECT tenant, id, seq FROM seen WHERE op = 'saved' AND before = 'removed'")
def keyed_upsert_revive(spark, d):
    return writes.revivals(event_log(spark, d)).select("tenant", "id", "seq")


@query(f"""WITH {LOG}, first AS (SELECT tenant, id, min(instant) AS f FROM log WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT l.tenant, l.id, l.seq FROM log l LEFT JOIN first f ON f.tenant = l.tenant AND f.id = l.id
WHERE l.op = 'saved' AND l.event_type <> 'signup' AND (f.f IS NULL OR l.instant < f.f)""")
def save_requires_existing(spark, d):
    return writes.missing(event_log(spark, d), F.col("event_type") == "signup").select("tenant", "id", "seq")


@query(f"WITH {LOG} SELECT tenant, id, seq FROM dead")
def remove_log(spark, d):
    return log.effective_removals(event_log(spark, d)).select("tenant", "id", "seq")


@query(f"""WITH {LOG} SELECT c_custkey % 16 AS tenant, c_custkey AS id, coalesce(NOT g.removed, false) AS took_effect
FROM customer LEFT JOIN got g ON g.tenant = c_custkey % 16 AND g.id = c_custkey""")
def remove_batch(spark, d):
    asked = table(spark, d, "customer").select((F.col("c_custkey") % 16).alias("tenant"), F.col("c_custkey").alias("id"))
    return writes.removals(event_log(spark, d), asked)


GUARDS = """guards AS (SELECT tenant, id, max(seq) FILTER (WHERE event_type <> 'view') AS expected FROM log GROUP BY tenant, id)"""


def _guards(rows):
    return rows.groupBy("tenant", "id").agg(F.max(F.when(F.col("event_type") != "view", F.col("seq"))).alias("expected"))


@query(f"""WITH {LOG}, {GUARDS} SELECT g.tenant, g.id, g.expected, r.seq AS actual FROM guards g LEFT JOIN last_row r
ON r.tenant = g.tenant AND r.id = g.id WHERE g.expected IS DISTINCT FROM r.seq""")
def expect_conflicts(spark, d):
    rows = event_log(spark, d)
    return writes.conflicts(rows, _guards(rows)).select("tenant", "id", "expected", "actual")


@query("SELECT count(*) AS n FROM events")
def atomic_batch(spark, d):
    rows = event_log(spark, d)
    return writes.guarded_batch(rows, rows, _guards(rows)).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG} SELECT event_type, count(*) AS n FROM (SELECT event_type FROM log UNION ALL SELECT event_type FROM log WHERE op = 'saved') GROUP BY event_type""")
def atomic_batch_accepted(spark, d):
    rows = event_log(spark, d)
    now = log.latest(rows).select("tenant", "id", F.col("seq").alias("expected"))
    return writes.guarded_batch(rows, rows.filter("op = 'saved'"), now).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH log AS (SELECT o_custkey % 16 AS tenant, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
floors AS (SELECT tenant, max(id) AS floor FROM log GROUP BY tenant),
c AS (SELECT o.o_custkey % 16 AS tenant, o_totalprice, o_orderkey * 3 % 1000 AS clock, coalesce(floor, 0) AS floor,
             row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderdate, o_orderkey) AS i
      FROM orders o LEFT JOIN floors f ON f.tenant = o.o_custkey % 16 WHERE o_orderpriority <> '1-URGENT'),
m AS (SELECT tenant, o_totalprice AS price, i + greatest(floor, max(clock - i) OVER (PARTITION BY tenant ORDER BY i)) AS id FROM c)
SELECT tenant, id, id AS instant, id AS seq, 'saved' AS op, price FROM m""")
def insert_minted(spark, d):
    rows = table(spark, d, "orders").withColumn("tenant", F.col("o_custkey") % 16)
    own = rows.filter("o_orderpriority = '1-URGENT'").select("tenant", F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("instant"), F.col("o_orderkey").alias("seq"), F.lit("saved").alias("op"), F.col("o_totalprice").alias("price"))
    new = rows.filter("o_orderpriority <> '1-URGENT'").select("tenant", F.col("o_totalprice").alias("price"), (F.col("o_orderkey") * 3 % 1000).alias("clock"), "o_orderdate", "o_orderkey")
    return writes.insert(own, new, "clock", ["o_orderdate", "o_orderkey"])


@query()
def file_census(spark, d):
    """Files of the tables with their sizes, blocks read and rows; SQL over the views knows no files."""
    from functools import reduce

    from tidelog.sources.tables import census

    return reduce(DataFrame.unionByName, [census(table(spark, d, n)).withColumn("table", F.lit(n)) for n in ("events", "orders", "documents")])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def adopt_idempotent(spark, d):
    rows = event_log(spark, d)
    return writes.adopt(rows, rows).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


GRAMS = "list_distinct(list_transform(range(1, length({t}) + 3), lambda i: substr(repeat(chr(1114111), 2) || {t} || repeat(chr(1114111), 2), i, 3)))"


@query(f"""WITH t AS (SELECT p_partkey, {GRAMS.format(t="p_name")} AS a, {GRAMS.format(t="p_name || ' ' || lower(p_type)")} AS b FROM part)
SELECT p_partkey, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS n_added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_taken FROM t""")
def posting_delta(spark, d):
    added, taken = fuzzy.posting_delta(F.col("p_name"), F.concat("p_name", F.lit(" "), F.lower("p_type")))
    return table(spark, d, "part").select("p_partkey", F.size(added).cast("long").alias("n_added"), F.size(taken).cast("long").alias("n_taken"))


@query("SELECT p_partkey FROM part WHERE p_brand || '/' || p_name <> CASE WHEN p_size = 11 THEN p_brand || '/other' ELSE p_brand || '/' || p_name END")
def key_mismatch(spark, d):
    rows = table(spark, d, "part").withColumn("stored", F.when(F.col("p_size") == 11, F.concat("p_brand", F.lit("/other"))).otherwise(F.concat_ws("/", "p_brand", "p_name")))
    return writes.key_mismatch(rows, F.concat_ws("/", "p_brand", "p_name"), "stored").select("p_partkey")


@query("""WITH c AS (SELECT o_orderkey, o_custkey % 16 AS tenant, o_orderkey * 3 % 1000 AS clock, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT o_orderkey, tenant, i + greatest(500, max(clock - i) OVER (PARTITION BY tenant ORDER BY i)) AS instant FROM c""")
def mint_instants(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 16).alias("tenant"), (F.col("o_orderkey") * 3 % 1000).alias("clock"))
    return writes.mint_instants(rows, "clock", ["o_orderdate", "o_orderkey"], F.lit(500).cast("long")).select("o_orderkey", "tenant", "instant")


# projections, filters, orders


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def by_exact(spark, d):
    rows = order.by(_orders(spark, d), ["o_orderpriority"], Bound.exact("1-URGENT"))
    return order.ranked(rows, [F.asc("o_orderkey")]).select("o_orderkey", F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
def by_range(spark, d):
    return order.by(_orders(spark, d), ["o_totalprice"], Bound.between(100000.0, 150000.0)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def by_composite_exact(spark, d):
    return order.by(table(spark, d, "part"), ["p_brand", "p_type"], Bound.exact("Brand#2", "ECONOMY")).select("p_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE (n_regionkey > 1 OR (n_regionkey = 1 AND n_name >= 'NATION_16')) AND (n_regionkey < 3 OR (n_regionkey = 3 AND n_name < 'NATION_2'))")
def by_composite_range(spark, d):
    return order.by(table(spark, d, "nation"), ["n_regionkey", "n_name"], Bound.between((1, "NATION_16"), (3, "NATION_2"))).select("n_nationkey", "n_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' AND starts_with(p_name, 'sm')")
def by_prefix(spark, d):
    return order.by(table(spark, d, "part"), ["p_brand", "p_name"], Bound.prefix("Brand#2", "sm")).select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name FROM nation")
def by_all(spark, d):
    return order.by(table(spark, d, "nation"), ["n_name"], Bound()).select("n_nationkey", "n_name")


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders
WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1997-03-01'""")
def listed_where(spark, d):
    rows = order.by(_orders(spark, d), ["o_orderdate"], Bound.between(F.lit("1997-01-01").cast("timestamp"), F.lit("1997-03-01").cast("timestamp")))
    return order.ranked(rows, _by_date()).select("o_orderkey", "o_totalprice", F.col("n").cast("long").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD' OR (c_mktsegment = 'MACHINERY' AND c_nationkey IN (7, 8))
OR (c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY') AND c_nationkey = 7)""")
def permission_visible(spark, d):
    kind = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "public").when(F.col("c_mktsegment") == "MACHINERY", "tenants")
    rows = table(spark, d, "customer").select(
        "c_custkey", kind.alias("kind"), F.array("c_nationkey", F.col("c_nationkey") - 1).alias("tenants"), F.col("c_nationkey").alias("tenant")
    )
    return rows.filter(navigate.visible_to(7)).select("c_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def field_projection(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size").filter("p_size > 40")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def listed(spark, d):
    return order.ranked(_orders(spark, d), _by_date()).select("o_orderkey", F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 1000")
def listed_at(spark, d):
    return order.listed(_orders(spark, d), _by_date(), offset=1000).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 30")
def listed_page(spark, d):
    return order.listed(_orders(spark, d), _by_date(), offset=3 * 10, limit=10).select("o_orderkey")


# navigation


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity = 50""")
def two_phase_resolve(spark, d):
    index = table(spark, d, "lineitem").filter("l_quantity = 50").select("l_orderkey", "l_linenumber")
    records = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return navigate.resolve(index, records, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("""SELECT o.o_orderkey, count(l.l_orderkey) AS n_items, min(l.l_linenumber) AS first_line FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey""")
def nested_collect(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    nested = navigate.nest(table(spark, d, "orders").select("o_orderkey"), items, "o_orderkey", "l_orderkey", "items")
    return nested.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.array_min(F.col("items.l_linenumber")).alias("first_line"))


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def ids_intersect(spark, d):
    return setops.intersect(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id")


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'en'")
def ids_union(spark, d):
    return setops.union(table(spark, d, "labels"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id")


@query("""WITH firsts AS (SELECT doc_id, min((side, place)) AS first FROM (
  SELECT doc_id, 0 AS side, doc_id % 1000 AS place FROM labels UNION ALL SELECT doc_id, 1, doc_id % 1000 FROM documents WHERE lang = 'en') GROUP BY doc_id)
SELECT doc_id, row_number() OVER (ORDER BY first, doc_id) AS n FROM firsts""")
def ids_union_ordered(spark, d):
    return setops.union_in_order(table(spark, d, "labels"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id", F.col("doc_id") % 1000)


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def ids_except(spark, d):
    return setops.except_(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id")


# history and changes


@query(f"WITH {LOG} SELECT id, seq, row_number() OVER (PARTITION BY tenant, id ORDER BY instant DESC, seq DESC) AS n FROM log WHERE op = 'saved'")
def history(spark, d):
    return log.history(event_log(spark, d)).select("id", "seq", F.col("n").cast("long").alias("n"))


@query(f"WITH {LOG} SELECT seq, value, row_number() OVER (ORDER BY instant DESC, seq DESC) AS n FROM log WHERE op = 'saved' AND id = 7")
def unique_history(spark, d):
    return log.history(event_log(spark, d).filter("id = 7")).select("seq", "value", F.col("n").cast("long").alias("n"))


@query(f"""WITH {LOG} SELECT id, seq, lag(seq) OVER w AS previous, lead(seq) OVER w AS next, coalesce(after = 'removed', false) AS removed
FROM seen WHERE op = 'saved' WINDOW w AS (PARTITION BY tenant, id ORDER BY instant, seq)""")
def chain_links(spark, d):
    return log.versions(event_log(spark, d)).select("id", "seq", "previous", "next", "removed")


@query("""WITH past AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'),
l AS (SELECT user_id, arg_max(event_type, ts) AS t, arg_max(event_id, ts) FILTER (WHERE event_type <> 'error') AS seq FROM past GROUP BY user_id)
SELECT user_id % 16 AS tenant, user_id AS id, seq FROM l WHERE t <> 'error' AND seq IS NOT NULL""")
def as_of(spark, d):
    return log.as_of(event_log(spark, d), F.expr(T0)).select("tenant", "id", "seq")


@query(f"""WITH {LOG} SELECT tenant, 'saved' AS kind, id, seq FROM live WHERE instant > TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT tenant, 'removed', id, seq FROM dead WHERE instant > TIMESTAMP '2024-01-20 00:00:00'""")
def collection_changes(spark, d):
    return changes.collection_changes(event_log(spark, d), F.expr(T0)).select("tenant", "kind", "id", "seq")


CURSORS = """cursors AS (SELECT tenant, id, CASE WHEN id % 2 = 0 THEN min(seq) FILTER (WHERE op = 'saved' AND instant >= TIMESTAMP '2024-01-20') ELSE -1 END AS since_seq
FROM log GROUP BY tenant, id)"""


@query(f"""WITH {LOG}, {CURSORS}, since_at AS (SELECT c.*, s.instant AS since FROM cursors c LEFT JOIN log s ON s.op = 'saved' AND s.seq = c.since_seq AND s.id = c.id)
SELECT l.tenant, l.id, l.seq FROM log l JOIN since_at a ON a.tenant = l.tenant AND a.id = l.id WHERE l.op = 'saved' AND l.instant > a.since
UNION ALL SELECT g.tenant, g.id, g.seq FROM got g JOIN since_at a ON a.tenant = g.tenant AND a.id = g.id WHERE a.since IS NULL AND g.seq > a.since_seq""")
def unique_changes(spark, d):
    rows = event_log(spark, d)
    late = F.min(F.when((F.col("op") == "saved") & (F.col("instant") >= F.expr(T0)), F.col("seq")))
    cursors = rows.groupBy("tenant", "id").agg(late.alias("late")).select("tenant", "id", F.when(F.col("id") % 2 == 0, F.col("late")).otherwise(-1).alias("since_seq"))
    return changes.unique_changes(rows, cursors).select("tenant", "id", "seq")


@query(f"""WITH {LOG}, took AS (SELECT tenant, instant, seq FROM log WHERE op = 'saved' UNION ALL SELECT tenant, instant, seq FROM dead)
SELECT tenant, arg_max(seq, instant) AS cursor FROM took GROUP BY tenant""")
def changes_register(spark, d):
    return changes.register(event_log(spark, d))


TOPICS = "topics AS (SELECT DISTINCT tenant, CASE WHEN tenant % 2 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS since FROM log)"


def _topics(rows):
    return rows.select("tenant").distinct().withColumn("since", F.when(F.col("tenant") % 2 == 0, F.expr(T0)))


@query(f"""WITH {LOG}, {TOPICS}, every AS (SELECT tenant, 'saved' AS kind, id, seq, instant FROM live UNION ALL SELECT tenant, 'removed', id, seq, instant FROM dead)
SELECT e.tenant, e.kind, e.id, e.seq FROM every e JOIN topics t ON t.tenant = e.tenant WHERE e.instant > t.since""")
def poll_sync(spark, d):
    rows = event_log(spark, d)
    return changes.poll(rows, _topics(rows)).select("tenant", "kind", "id", "seq")


@query(f"""WITH {LOG}, took AS (SELECT tenant, instant, seq FROM log WHERE op = 'saved' UNION ALL SELECT tenant, instant, seq FROM dead)
SELECT tenant, strftime(max(instant), '%Y-%m-%d %H:%M:%S') AS cursor FROM took GROUP BY tenant""")
def poll_cursors(spark, d):
    rows = event_log(spark, d)
    return changes.poll_cursors(rows, _topics(rows)).select("tenant", F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"))


# fuzzy search

PLAIN = "".join(k * len(v) for k, v in text.FOLDS.items())
MARKED = "".join(text.FOLDS.values())
NORM = f"trim(regexp_replace(translate(lower({{t}}), '{MARKED}', '{PLAIN}'), '\\s+', ' ', 'g'))"
for _letter, _two in text.EXPANSIONS.items():
    NORM = f"replace({NORM}, '{_letter}', '{_two}')"


@query(f"SELECT p_partkey, CAST(levenshtein('smal gear', {NORM.format(t='p_name')}) AS DOUBLE) AS rank FROM part WHERE levenshtein('smal gear', {NORM.format(t='p_name')}) <= 2 ORDER BY rank, p_partkey LIMIT 50")
def fuzzy_distance(spark, d):
    return fuzzy.fuzzy_search(table(spark, d, "part"), "p_name", "Smal  Gear", "distance", 2, 50, "p_partkey").select("p_partkey", "rank")


def _share_sql(share: str, least: float, q: str, k: int) -> str:
    return f"""WITH t AS (SELECT p_partkey, {GRAMS.format(t=NORM.format(t='p_name'))} AS g, {GRAMS.format(t=f"'{q}'")} AS q FROM part),
s AS (SELECT p_partkey, {share} AS s FROM t)
SELECT p_partkey, round(1 - s, 9) AS rank FROM s WHERE s >= {least} ORDER BY 1 - s, p_partkey LIMIT {k}"""


@query(_share_sql("len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))", 0.4, "small gizmo", 40))
def fuzzy_similarity(spark, d):
    return fuzzy.fuzzy_search(table(spark, d, "part"), "p_name", "small gizmo", "similarity", 0.4, 40, "p_partkey").select("p_partkey", F.round("rank", 9).alias("rank"))


@query(_share_sql("len(list_intersect(g, q)) / len(q)", 0.3, "bolt", 40))
def fuzzy_contains(spark, d):
    return fuzzy.fuzzy_search(table(spark, d, "part"), "p_name", "bolt", "contains", 0.3, 40, "p_partkey").select("p_partkey", F.round("rank", 9).alias("rank"))


@query(f"SELECT doc_id, {NORM.format(t='text')} AS text FROM documents")
def normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("text"))


# windows of three by shifted lists of characters, since substr() counts from the start of a text
CHARS = f"string_split(repeat(chr(1114111), 2) || {NORM} || repeat(chr(1114111), 2), '')"
WINDOWS = "list_distinct(list_transform(list_zip(c[:-3], c[2:-2], c[3:]), lambda x: x[1] || x[2] || x[3]))"


@query(f"WITH t AS (SELECT doc_id, {CHARS.format(t='text')} AS c FROM documents) SELECT doc_id, len({WINDOWS}) AS n_grams FROM t")
def gram_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.grams(text.normalize(F.col("text")))).cast("long").alias("n_grams"))


@query(f"""WITH q AS (SELECT item_id, {WINDOWS} AS g FROM (SELECT item_id, {CHARS.format(t='text')} AS c FROM benchmark)),
lines AS (SELECT doc_id, {NORM.format(t='line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
r AS (SELECT line, {WINDOWS} AS g FROM (SELECT line, string_split(repeat(chr(1114111), 2) || line || repeat(chr(1114111), 2), '') AS c FROM (SELECT DISTINCT line FROM lines))),
c AS (SELECT item_id, line, any_value(qn) AS qn, any_value(rn) AS rn, count(*) AS b
      FROM (SELECT line, len(g) AS rn, unnest(g) AS gram FROM r) JOIN (SELECT item_id, len(g) AS qn, unnest(g) AS gram FROM q) USING (gram) GROUP BY item_id, line),
s AS (SELECT item_id, doc_id, max(b / (qn + rn - b)) AS score FROM c JOIN lines USING (line) WHERE b / (qn + rn - b) >= 0.25 GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(score, 9) AS score, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s) WHERE n <= 3""")
def fuzzy_batch(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = fuzzy.fuzzy_batch(table(spark, d, "benchmark"), lines, ("item_id", "text"), ("doc_id", "line"), 0.25, 3)
    return found.select("item_id", "doc_id", F.round("score", 9).alias("score"), F.col("n").cast("long").alias("n"))


# ids, hashes, placement


@query("SELECT o_orderkey, o_custkey * 65536 + 32768 * (o_orderkey % 2) + o_orderkey % 1000 AS low, o_custkey AS tenant FROM orders")
def id_pack(spark, d):
    low = ids.low_half(F.col("o_custkey"), F.col("o_orderkey") % 2, F.col("o_orderkey") % 1000)
    return table(spark, d, "orders").select("o_orderkey", low.alias("low"), ids.tenant_of(low).alias("tenant"))


@query("SELECT o_orderkey, (o_orderkey * 1000003) & 32767 AS salt FROM orders")
def type_salt(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.type_salt(F.col("o_orderkey") * 1000003).alias("salt"))


@query("SELECT o_orderkey, o_orderkey * 7 AS key, o_custkey AS tenant, 1 - CAST(o_orderkey % 2 AS INTEGER) AS flag, CAST(123456789 & 32767 AS INTEGER) AS salt FROM orders")
def archive_id(spark, d):
    made = ids.archive_id(F.col("o_orderkey") * 7, F.col("o_custkey"), F.col("o_orderkey") % 2, F.lit(123456789).cast("long"))
    return table(spark, d, "orders").select("o_orderkey", made.alias("i")).select("o_orderkey", "i.*")


@query(seahash_sql("c_custkey", f"{wire_sql('c_name')} || {wire_sql('c_mktsegment')}", "customer", "SELECT k AS c_custkey, signed AS key FROM hashes"))
def seahash_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.natural_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query(
    seahash_sql(
        "o_orderkey",
        f"{little_endian_sql('o_orderkey', 8)} || {little_endian_sql('o_custkey % 32768', 2)}",
        "orders",
        f"SELECT CAST(h % {hashing.DEFAULT_SHARDS}::UHUGEINT AS INTEGER) AS shard, count(*) AS n FROM hashes GROUP BY shard",
    )
)
def placement_histogram(spark, d):
    owner = hashing.collection_owner(F.col("o_orderkey"), F.lit(0), F.col("o_custkey") % 32768)
    placed = table(spark, d, "orders").select(hashing.shard(owner).alias("shard"))
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(seahash_sql("c_custkey", f"hex(encode('recency')) || {little_endian_sql('c_custkey', 8)}", "customer", "SELECT k AS c_custkey, signed AS lane FROM hashes"))
def lane_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.lane("recency", F.col("c_custkey")).alias("lane"))


@query("SELECT c_custkey, sha256(c_name) AS token_sha256 FROM customer")
def sha256_token(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("token_sha256"))


@query("SELECT o_orderkey, o_orderkey * 777777 // 1000000 * 1000000 + (row_number() OVER (ORDER BY o_orderkey) - 1) % 1000000 AS key FROM orders")
def key_nanos(spark, d):
    counted = order.ranked(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    return counted.select("o_orderkey", ids.key_nanos(F.col("o_orderkey") * 777777, F.col("n") - 1).alias("key"))


@query("""WITH p AS (SELECT p_partkey, regexp_extract(upper(substr(md5(p_name), 1, 8)), '^((?:..)*?)(?:FF)*$', 1) AS kept FROM part)
SELECT p_partkey, CASE WHEN kept <> '' THEN substr(kept, 1, length(kept) - 2) || printf('%02X', ('0x' || right(kept, 2))::INTEGER + 1) END AS above FROM p""")
def prefix_successor(spark, d):
    prefix = F.unhex(F.substring(F.md5("p_name"), 1, 8))
    return table(spark, d, "part").select("p_partkey", F.hex(ids.successor(prefix)).alias("above"))


@query(f"SELECT c_custkey, hex(encode(c_name) || {mac_sql('encode(c_name)', SECRETS[0])}) AS token FROM customer")
def token_sign(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.hex(tokens.sign(F.encode("c_name", "UTF-8"), SECRETS[0])).alias("token"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'malformed' WHEN c_custkey % 5 = 0 THEN 'signature'
WHEN c_nationkey <= 4 THEN 'expired' WHEN c_mktsegment <> 'BUILDING' THEN 'purpose' END AS fault FROM customer""")
def token_verify(spark, d):
    claims = F.encode(F.concat_ws("|", "c_nationkey", "c_mktsegment"), "UTF-8")
    signed = F.when(F.col("c_custkey") % 5 == 0, tokens.sign(claims, SECRETS[1])).otherwise(tokens.sign(claims, SECRETS[0]))
    sent = F.when(F.col("c_custkey") % 7 == 0, F.substring(signed, F.lit(1), F.lit(tokens.MAC_BYTES - 1))).otherwise(signed)
    held = table(spark, d, "customer").select("c_custkey", sent.alias("token"))
    told = F.split(F.decode(tokens.claims_of(F.col("token")), "UTF-8"), "[|]", 2)
    read = held.withColumns({"expires": F.get(told, 0).try_cast("long"), "purpose": F.get(told, 1)})
    return read.select("c_custkey", tokens.fault(F.col("token"), SECRETS[0], F.col("expires"), F.col("purpose"), F.lit(4), "BUILDING").alias("fault"))


# applications


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 42")
def shop_profile(spark, d):
    return navigate.profile(table(spark, d, "customer"), table(spark, d, "nation"), 42)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42 ORDER BY o_orderdate, o_orderkey LIMIT 10")
def shop_order_page(spark, d):
    return navigate.order_page(table(spark, d, "orders"), 42, page=0).select("o_orderkey", "o_totalprice")


@query("""WITH f AS (SELECT o_orderkey FROM orders WHERE o_custkey = 42 ORDER BY o_orderdate, o_orderkey LIMIT 1)
SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN f ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey ORDER BY p_name, l_linenumber, l_partkey LIMIT 10""")
def shop_order_detail(spark, d):
    return navigate.order_detail(table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part"), 42)


@query("""SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'AMERICA' AND s_acctbal > 1000""")
def nested_index_lookup(spark, d):
    holders = table(spark, d, "region").filter("r_name = 'AMERICA'")
    nations = navigate.follow(holders, table(spark, d, "nation"), "r_regionkey", "n_regionkey")
    return navigate.follow(nations, table(spark, d, "supplier").filter("s_acctbal > 1000"), "n_nationkey", "s_nationkey").select("s_suppkey", "s_name")


@query("""SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n_orders, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS n_items
FROM events GROUP BY user_id""")
def checkout_fold(spark, d):
    return navigate.checkout(table(spark, d, "events"))


@query("""WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, count(*) FILTER (WHERE event_type = 'signup' AND p IS DISTINCT FROM 'signup') AS n_rotations,
       count(*) FILTER (WHERE event_type = 'signup' AND p = 'signup') > 0 AS revoked FROM s GROUP BY user_id""")
def session_refresh(spark, d):
    return navigate.session_refresh(table(spark, d, "events"))


@query("""WITH n AS (SELECT *, event_id % 2 AS generation, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error'),
s AS (SELECT *, min(CASE WHEN generation <> n - 1 THEN n END) OVER (PARTITION BY user_id) AS stop FROM n)
SELECT event_id, CASE WHEN n > stop THEN 'refused' WHEN n = stop THEN 'revoked' ELSE 'rotated' END AS outcome FROM s
UNION ALL SELECT event_id, 'refused' FROM events WHERE event_type = 'error'""")
def session_rotation(spark, d):
    minted = lambda generation: tokens.sign(F.encode(F.concat_ws("|", F.col("user_id"), generation), "UTF-8"), SECRETS[0])
    presented = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    judged = sessions.rotate(presented, "user_id", ["ts", "event_id"], minted(F.col("event_id") % 2), minted, F.col("event_type") != "error")
    return judged.select("event_id", "outcome")


@query("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS node FROM events)
SELECT user_id, count(*) AS n_replayed, arg_max(value, ts) AS last_value FROM q WHERE event_type = 'click' AND (node IS NULL OR ts > node) GROUP BY user_id""")
def offline_replay(spark, d):
    return navigate.offline_replay(table(spark, d, "events"))


@query("""WITH s AS (SELECT *, min(CASE WHEN event_type = 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS stop FROM events)
SELECT event_id, CASE WHEN stop IS NOT NULL AND (ts, event_id) >= stop THEN 'kept' WHEN event_type = 'signup' THEN 'dropped' ELSE 'sent' END AS outcome FROM s""")
def offline_drain(spark, d):
    queue = table(spark, d, "events")
    return navigate.drain(queue, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup").select("event_id", "outcome")


@query(f"WITH {LOG} SELECT id, seq FROM live WHERE tenant = 3")
def watch_stream(spark, d):
    from tidelog.streaming.watch import replay

    return replay(spark, f"{d}/events.parquet", tenant=3)


@query("SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM orders GROUP BY o_orderpriority")
def page_census(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_keys"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def server_function(spark, d):
    from tidelog.plans.registry import SHOP

    return SHOP.call("customers_in", spark, d, "BUILDING")
