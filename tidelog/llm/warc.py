"""WARC not-modified revisits: as-of join to the latest earlier full response of the same canonical URL.

A revisit record (status 304) refers to what was captured before. For each one the
latest response with an earlier time and the same canonical URL is found; validators
are compared (entity tags, weakly; else the modification time), and if they agree the
stored headers are merged with those that a 304 may update.

The as-of join is two window passes in DataFrame functions. Times are cut into
``BLOCKS`` ranges of about equal numbers of records (by approximate percentiles over
all records), so that a URL which a third of all records share is spread over the
ranges. Within (URL, range) a running maximum gives the latest earlier response; the
last response of each range is then carried over to later ranges, one row per URL and
range. Payloads never move: the result names the record that holds the payload.

Defined cases: a record without URL or time is no response that others find, and as a
revisit is unresolved (``no url or time``); a response of the same time is not earlier;
of responses of one time the larger record_id counts; a record_id that stands twice
gives two rows; null headers are empty; a revisit without validators, or whose stored
response lacks the same kind, is unresolved (``no validator``); an empty table gives no
rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.runtime import table
from tidelog.llm.url_filter import url_host, url_path, url_rest

BLOCKS = 64

# Header fields that a 304 response may update, and query keys that only track.
UPDATABLE = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "vary", "warning"]
TRACKING = r"^(utm_[a-z]+|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host without www. and default port, path without a last slash, other query parts sorted; null without ``://``."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url_rest(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    joined = F.array_join(parts, "&")
    return F.when(F.locate("://", url) > 0, F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored fields, those that may be updated taken from ``update``; both maps have lower-case keys."""
    allowed = F.map_filter(update, lambda k, _: k.isin(UPDATABLE))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row per revisit of records (record_id, url, ts long, kind, etag, last_modified, headers map).

    Gives record_id, canonical, ts, refers_to, outcome, headers (merged; the revisit's own if unresolved).
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "etag", "last_modified", F.coalesce("headers", none).alias("headers")
    )
    usable = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    placed = rows.filter(usable)
    cuts = placed.agg(F.percentile_approx("ts", [k / blocks for k in range(1, blocks)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    placed = placed.withColumn("block", block)

    stored = F.struct("record_id", "etag", "last_modified", "headers")
    order = F.struct("ts", "record_id")
    response = F.col("kind") == "response"
    earlier = Window.partitionBy("canonical", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    latest = lambda: F.max_by(F.when(response, stored), F.when(response, order))
    near = placed.withColumn("near", latest().over(earlier)).filter(F.col("kind") == "revisit")

    last = placed.filter(response).groupBy("canonical", "block").agg(latest().alias("last"))
    wanted = placed.filter(F.col("kind") == "revisit").select("canonical", "block").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    both = last.union(wanted).groupBy("canonical", "block").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = both.withColumn("far", F.last("last", ignorenulls=True).over(before)).select("canonical", "block", "far").filter("far is not null")

    found = near.join(far, ["canonical", "block"], "left").withColumn("stored", F.coalesce("near", "far"))
    tags = F.col("etag").isNotNull() & F.col("stored.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("stored.last_modified").isNotNull()
    agrees = F.when(tags, _weak(F.col("etag")) == _weak(F.col("stored.etag"))).when(times, F.col("last_modified") == F.col("stored.last_modified"))
    outcome = (
        F.when(F.col("stored").isNull(), "no earlier response").when(agrees.isNull(), "no validator").when(agrees, "resolved").otherwise("modified")
    )
    found = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    out = found.select(
        "record_id",
        "canonical",
        "ts",
        F.when(resolved, F.col("stored.record_id")).alias("refers_to"),
        "outcome",
        F.when(resolved, merged_headers(F.col("stored.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
    lost = rows.filter(~usable & (F.col("kind") == "revisit"))
    return out.union(
        lost.select("record_id", "canonical", "ts", F.lit(None).cast(out.schema["refers_to"].dataType), F.lit("no url or time"), "headers")
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records as a crawler would have written them for (page_id, url, html): of each page a response and a revisit.

    What the revisit looks like follows from a digest of the URL: most repeat the entity
    tag, some come first, some have another tag or none.
    """
    kind = F.substring(F.md5("url"), 1, 1)
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", (F.col("page_id") * 1000).alias("at"), kind.alias("k"), tag.alias("tag"), F.octet_length("html").cast("string").alias("size"))
    headers = lambda *x: F.create_map(*[F.lit(y) if isinstance(y, str) else y for y in x])
    response = base.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        F.col("at").alias("ts"),
        F.lit("response").alias("kind"),
        F.col("tag").alias("etag"),
        F.when(F.col("k") == "4", F.col("size")).alias("last_modified"),
        headers("content-type", "text/html", "content-length", F.col("size"), "etag", F.col("tag"), "date", F.col("at").cast("string")).alias("headers"),
    )
    revisit_tag = F.when(F.col("k").isin("1", "2"), F.lit('"changed"')).when(~F.col("k").isin("3", "4"), F.concat(F.lit("W/"), F.col("tag")))
    at = F.col("at") + F.when(F.col("k") == "0", -500).otherwise(500)
    revisit = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.concat("url", F.lit("#again")).alias("url"),
        at.alias("ts"),
        F.lit("revisit").alias("kind"),
        revisit_tag.alias("etag"),
        F.when(F.col("k") == "4", F.col("size")).alias("last_modified"),
        headers("date", at.cast("string"), "content-length", "0", "expires", "never").alias("headers"),
    )
    return response.union(revisit)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.select(
        "record_id",
        "canonical",
        "refers_to",
        "outcome",
        F.size("headers").cast("long").alias("n_headers"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("headers_sha256"),
    )


OP7_SQL = r"""
WITH base AS (
  SELECT page_id, url, page_id * 1000 AS t0, substr(md5(url), 1, 1) AS k, '"' || substr(md5(html), 1, 16) || '"' AS tag,
         CAST(strlen(html) AS VARCHAR) AS size,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
urls AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM base),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), CASE lower(split_part(url, '://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '$^' END, '') || regexp_replace(path, '/+$', '') ||
         CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical
  FROM (SELECT *, coalesce(array_to_string(list_sort(list_filter(string_split(query, '&'),
                 lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid)(=|$)'))), '&'), '') AS q FROM urls)),
responses AS (
  SELECT page_id * 2 AS record_id, canonical, t0 AS ts, tag AS etag, CASE WHEN k = '4' THEN size END AS lm, size FROM named),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, canonical, t0 + CASE WHEN k = '0' THEN -500 ELSE 500 END AS ts,
         CASE WHEN k IN ('1', '2') THEN '"changed"' WHEN k NOT IN ('3', '4') THEN 'W/' || tag END AS etag,
         CASE WHEN k = '4' THEN size END AS lm
  FROM named),
found AS (
  SELECT v.record_id, v.canonical, v.ts, v.etag, v.lm, r.record_id AS rid, r.ts AS rts, r.etag AS retag, r.lm AS rlm, r.size,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) AS n
  FROM revisits v LEFT JOIN responses r ON r.canonical = v.canonical AND r.ts < v.ts),
judged AS (
  SELECT *, CASE WHEN canonical IS NULL THEN 'no url or time' WHEN rid IS NULL THEN 'no earlier response'
                 WHEN etag IS NOT NULL AND retag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '') THEN 'resolved' ELSE 'modified' END
                 WHEN lm IS NOT NULL AND rlm IS NOT NULL THEN CASE WHEN lm = rlm THEN 'resolved' ELSE 'modified' END
                 ELSE 'no validator' END AS outcome
  FROM found WHERE n = 1)
SELECT record_id, canonical, CASE WHEN outcome = 'resolved' THEN rid END AS refers_to, outcome,
       CASE WHEN outcome = 'resolved' THEN 5 ELSE 3 END AS n_headers,
       sha256(CASE WHEN outcome = 'resolved'
              THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || retag || chr(10) || 'expires: never'
              ELSE 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'expires: never' END) AS headers_sha256
FROM judged
"""
