"""URL filters: listed rules by host and path first, then association rules mined from labels.

A URL becomes a set of tokens: scheme, words of the host, words of the path (numbers are
one token), and query keys. Spark's FP-growth finds frequent combinations among
labelled URLs, the label being a token; rules that lead to it are kept when their
support and confidence suffice, whatever their length, when so many bad URLs among those
that fit are not what chance gives (a binomial tail below ``CHANCE`` over all rules
tried), and when no shorter rule within them is as confident. An inverted index files
each rule under its rarest token; a URL looks up its own tokens and checks the rules found.

Labels come from outside the URL: a page is bad by the label of the same id (toxic, or of
low quality). How good the rules are on held-out pages is in the README.

Scale: mining is distributed. Spark's FP-growth spells out each frequent combination, so
their number is bounded from above before it: each stands in at least ``support`` URLs, and
a URL has two to the number of its frequent tokens; where that allows more than ``MAX_SETS``,
it mines from a doubled support on. The rules from the given support up to that one are grown
in ``_rest``, none is left out: each token has a conditional table (the rarer tokens of a URL
lead to the commoner ones), a table of more than ``table_rows`` rows is split by its next
token, and a worker grows one table at a time. It keeps tokens that stand in the same rows of
a table together, and counts the combinations that they allow without spelling them out. Rules
pass the test of chance on executors; the driver and workers hold those that are kept, whatever
their number. What grows without a bound is time, with the combinations that stand in different
sets of URLs. Matching is one narrow pass.

Defined cases: a null URL, or one without ``://``, has an empty host, path and token
set, fits no rule and is allowed; without labelled bad URLs there are no mined rules;
of rules of one length the smaller text wins; a repeated URL counts as often as it
stands; an empty table gives no rows; other columns pass through ``judge``, whatever
their names, those that it sets are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.runtime import cut, free_names, map_in_arrow, share, table

MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.8
CHANCE = 0.01
MAX_SETS = 50_000
TABLE_ROWS = 50_000
OUT_ROWS = 10_000
BAD = "label:bad"

# Listed rules (host, path, verdict).
LISTED = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none without ``://``."""
    some = lambda part, split, mark: F.transform(
        F.filter(F.split(F.lower(part), split), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x))
    )
    query = F.regexp_extract(url_rest(url), r"^[^?#]*\?([^#]*)", 1)
    all_of = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))),
        some(url_host(url), r"[.\-]", "host:"),
        some(url_path(url), r"[/._\-]+", "path:"),
        F.transform(some(query, "&", "query:"), lambda x: F.substring_index(x, "=", 1)),
    )
    return F.when(F.locate("://", url) > 0, F.array_distinct(all_of)).otherwise(F.array().cast("array<string>"))


def _frequent(known: DataFrame, least: float, max_sets: int) -> tuple[DataFrame, float]:
    """The items (with the label) cut to frequent tokens, and the support in URLs at which at most ``max_sets`` combinations are."""
    counts = {r["t"]: r["n"] for r in known.select(F.explode("items").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).collect()}
    while True:
        tokens = sorted(t for t, n in counts.items() if n >= least)
        kept = known.select(F.array_intersect("items", F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")).alias("items"))
        if (kept.agg(F.sum(F.pow(F.lit(2.0), F.size("items")))).first()[0] or 0) / least <= max_sets:
            return kept, least
        least *= 2


def _tail(hits: int, n: int, rate: float) -> float:
    """The chance of at least ``hits`` among n, each with chance ``rate``."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate) for k in range(hits, n + 1)]
    return sum(math.exp(x) for x in logs)


def _bits(at, n: int) -> int:
    """The set of the rows ``at`` of n, as the bits of a number."""
    mask = np.zeros(n, bool)
    mask[at] = True
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def _planes(counts: list[int]) -> list[int]:
    """The rows whose count has each binary digit."""
    found = np.array(counts, np.int64)
    return [_bits(np.flatnonzero(found >> b & 1), len(found)) for b in range(int(found.max()).bit_length())]


def _sum(rows: int, planes: list[int]) -> int:
    return sum((rows & plane).bit_count() << b for b, plane in enumerate(planes))


def grow(
    table: list[tuple[list[int], int, int]], least: int, below: int, min_confidence: float
) -> Iterator[tuple[tuple[tuple[int, ...], ...], int, int, int]]:
    """(units, hits, URLs, weight) of the rules with ``least`` <= hits < ``below`` in a conditional table of (items, hits, URLs).

    One item of each unit makes a rule. The weight counts the combinations with the same
    URLs that it stands for: some of each unit, and any of the items that all these URLs
    have. Combinations within the URLs of a rule that is always right cannot be kept; they
    are only counted, in a last row without hits.
    """
    hits_of, total_of = _planes([r[1] for r in table]), _planes([r[2] for r in table])
    where: dict[int, list[int]] = {}
    for k, (items, _, _) in enumerate(table):
        for t in items:
            where.setdefault(t, []).append(k)
    every = (1 << len(table)) - 1
    more = 0
    todo = [((), 1, every, _sum(every, hits_of), [(_bits(where[t], len(table)), (t,), 0) for t in sorted(where)], 0, False)]
    while todo:
        units, weight, rows, hits, others, start, right = todo.pop()
        if hits < least:
            continue
        alike: dict[int, tuple[tuple[int, ...], int]] = {}
        for k in range(start, len(others)):
            own = others[k][0] & rows
            if own == rows:
                weight <<= len(others[k][1])
            elif own in alike:
                alike[own] = (alike[own][0] + others[k][1], alike[own][1])
            elif (n := _sum(own, hits_of)) >= least:
                alike[own] = (others[k][1], n)
        total = _sum(rows, total_of)
        if hits < below and hits / total >= min_confidence:
            if right:
                more += weight
            else:
                yield units, hits, total, weight
        others = [(own, items, n) for own, (items, n) in alike.items()]
        for k, (own, items, n) in enumerate(others):
            todo.append(((*units, items), weight * ((1 << len(items)) - 1), own, n, others, k + 1, right or hits == total))
    if more:
        yield (), 0, 0, more


def _rest(known: DataFrame, least: int, below: int, min_confidence: float, table_rows: int) -> DataFrame:
    """(units, hits, total, weight) of all rules with ``least`` <= hits < ``below``, as in ``grow``."""
    spark = known.sparkSession
    tokens = known.select("bad", F.explode("items").alias("t")).filter(F.col("t") != BAD).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("hits"))
    order = [r["t"] for r in sorted(tokens.filter(F.col("hits") >= least).collect(), key=lambda r: (r["n"], r["t"]))]
    names, ranks = share(spark, order), share(spark, {t: k for k, t in enumerate(order)})

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(ranks.value[t] for t in items if t in ranks.value) for items in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("bad")], ["items", "bad"])

    out = pa.schema([("units", pa.list_(pa.list_(pa.string()))), ("hits", pa.int64()), ("total", pa.int64()), ("weight", pa.float64())])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("prefix", "items", "hits", "total")), strict=True))
            for prefix, own in itertools.groupby(rows, key=lambda r: r[0]):
                first = tuple((int(t),) for t in prefix.split())
                for units, hits, total, weight in grow([r[1:] for r in own], least, below, min_confidence):
                    yield [[names.value[t] for t in unit] for unit in (first + units if hits else ())], hits, total, float(min(weight, 1 << 1000))

        each = found()
        while some := list(itertools.islice(each, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*some, strict=True), out, strict=True)], schema=out)

    kind = "units array<array<string>>, hits long, total long, weight double"
    summed = (F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    tables = map_in_arrow(known.select("items", "bad"), ranked, "items array<int>, bad boolean").groupBy("items").agg(F.sum(F.col("bad").cast("long")).alias("hits"), F.count(F.lit(1)).alias("total")).withColumn("prefix", F.lit(""))
    parts = []
    while True:
        each = tables.select("*", F.posexplode("items").alias("at", "t"))
        each = each.select(F.concat("prefix", F.col("t").cast("string"), F.lit(" ")).alias("prefix"), F.expr("slice(items, at + 2, size(items))").alias("items"), "hits", "total")
        each = cut(each.groupBy("prefix", "items").agg(*summed))
        large = each.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"), *summed).filter(F.col("rows") > table_rows).collect()
        small = each.filter(~F.col("prefix").isin([r["prefix"] for r in large])) if large else each
        small = small.repartition(4 * spark.sparkContext.defaultParallelism, "prefix").sortWithinPartitions("prefix")
        parts.append(cut(map_in_arrow(small, grown, kind)))
        large = [r for r in large if r["hits"] >= least]
        # the combination by which a table is split is one of those looked for
        own = [([[order[int(t)]] for t in r["prefix"].split()], r["hits"], r["total"], 1.0) for r in large if r["hits"] < below and r["hits"] / r["total"] >= min_confidence]
        if own:
            parts.append(spark.createDataFrame(own, kind))
        if not large:
            return reduce(DataFrame.unionAll, parts)
        tables = each.filter(F.col("prefix").isin([r["prefix"] for r in large]))


def _needless(tokens: tuple[str, ...], confidence: float, under: dict[str, list[tuple[frozenset[str], float]]]) -> bool:
    """Whether a rule within these tokens is as confident; ``under`` has the rules by their first token."""
    own = frozenset(tokens)
    return any(c >= confidence and need <= own for t in tokens for need, c in under.get(t, ()))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_count: int = MIN_COUNT,
    chance: float = CHANCE,
    max_sets: int = MAX_SETS,
    table_rows: int = TABLE_ROWS,
) -> list[tuple[tuple[str, ...], float]]:
    """(tokens, confidence) of rules that lead to a bad label, from (url, bad boolean); the same whatever ``max_sets`` and ``table_rows``."""
    from pyspark.ml.fpm import FPGrowth

    known = labelled.filter("bad is not null").select("bad", url_tokens(F.col("url")).alias("items")).filter(F.size("items") > 0)
    known = cut(known.select("bad", F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    n, bad = known.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("long"))).first()
    if not n or not bad:
        return []
    support = max(min_support * n, min_count)
    items, least = _frequent(known, support, max_sets)
    # half a URL less, as Spark rounds the product of support and URLs up
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(least) - 0.5) / n), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent")[0] == BAD).select("antecedent", "confidence", "support").collect()
    tried, rest = len(rules), None
    if least > support:
        rest = _rest(known, math.ceil(support), math.ceil(least), min_confidence, table_rows)
        tried += rest.agg(F.sum("weight")).first()[0] or 0

    def likely(hits: int, total: int) -> bool:
        return bad == n or _tail(hits, total, bad / n) * tried <= chance

    found = {}
    for r in rules:
        hits = round(r["support"] * n)
        if likely(hits, round(hits / r["confidence"])):
            found[tuple(sorted(r["antecedent"]))] = r["confidence"]
    lengths = {len(tokens) for tokens in found}
    if rest is not None:

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[int, int], bool] = {}
            for batch in batches:
                pairs = list(zip(batch.column("hits").to_pylist(), batch.column("total").to_pylist(), strict=True))
                seen.update((x, likely(*x)) for x in set(pairs) - seen.keys())
                yield batch.filter(pa.array([seen[x] for x in pairs], pa.bool_()))

        rest = cut(map_in_arrow(rest.filter("hits > 0"), passing, rest.schema))
        lengths |= {r[0] for r in rest.select(F.size("units")).distinct().collect()}

    # shorter rules first: a needless one has a kept one within it that is as confident
    kept: dict[tuple[str, ...], float] = {}
    under: dict[str, list[tuple[frozenset[str], float]]] = {}
    for length in sorted(lengths):
        new = [(tokens, c) for tokens, c in found.items() if len(tokens) == length and not _needless(tokens, c, under)]
        if rest is not None:
            new += _needed(rest.filter(F.size("units") == length), under)
        for tokens, c in new:
            kept[tokens] = c
            under.setdefault(tokens[0], []).append((frozenset(tokens), c))
    return sorted(kept.items())


def _needed(rest: DataFrame, under: dict[str, list[tuple[frozenset[str], float]]]) -> list[tuple[tuple[str, ...], float]]:
    """The rules of these units that are not needless, each with one token of each unit."""
    shared = share(rest.sparkSession, under)
    out = pa.schema([("tokens", pa.list_(pa.string())), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("units", "hits", "total")), strict=True))
        each = ((t, hits / total) for units, hits, total in rows for t in map(tuple, map(sorted, itertools.product(*units))) if not _needless(t, hits / total, shared.value))
        while some := list(itertools.islice(each, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*some, strict=True), out, strict=True)], schema=out)

    return [(tuple(r["tokens"]), r["confidence"]) for r in map_in_arrow(rest, run, "tokens array<string>, confidence double").collect()]


class RuleIndex:
    """Rules under their rarest token (rarest among the rules' tokens)."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float]]) -> None:
        uses: dict[str, int] = {}
        for tokens, _ in rules:
            for t in tokens:
                uses[t] = uses.get(t, 0) + 1
        self.under: dict[str, list[tuple[frozenset[str], float, str]]] = {}
        for tokens, confidence in rules:
            anchor = min(tokens, key=lambda t: (uses[t], t))
            self.under.setdefault(anchor, []).append((frozenset(tokens), confidence, " ".join(tokens)))

    def best(self, tokens: list[str]) -> tuple[float, str] | None:
        own, best = set(tokens), None
        for t in tokens:
            for need, confidence, text in self.under.get(t, ()):
                if need <= own and (best is None or (-confidence, text) < (-best[0], best[1])):
                    best = (confidence, text)
        return best


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, mined: list[tuple[tuple[str, ...], float]], listed: list[tuple[str, str, str]] = LISTED) -> DataFrame:
    """The columns of pages (with url), and host, path, rule, verdict, mined_rule, confidence."""
    (own,) = free_names([*pages.columns, "host", "path", "rule", "verdict", "mined_rule", "confidence"], "_tokens")
    out = pages.withColumns(
        {
            "host": url_host(F.col("url")),
            "path": url_path(F.col("url")),
            "mined_rule": F.lit(None).cast("string"),
            "confidence": F.lit(None).cast("double"),
            own: url_tokens(F.col("url")),
        }
    )
    if mined:
        shared = share(pages.sparkSession, RuleIndex(mined))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shared.value.best(tokens) or (None, None) for tokens in batch.column(own).to_pylist()]
                for k, (name, kind) in enumerate((("confidence", pa.float64()), ("mined_rule", pa.string()))):
                    at = batch.schema.get_field_index(name)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array([x[k] for x in found], kind))
                yield batch

        out = map_in_arrow(out, run, out.schema)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)}).drop(own)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): by the label of the same id, toxic or of low quality; null if unlabelled."""
    own = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return pages.join(own, "page_id", "left").select("url", "bad")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = mine_rules(labelled_pages(pages, table(spark, sf_dir, "labels")))
    return judge(pages, mined).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
