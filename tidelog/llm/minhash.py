"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

Documents are sets of distinct shingles of ``WIDTH`` words. Two are linked when
``100 * |intersection| >= percent * |union|``; components of linked documents follow.

Steps, each a DataFrame:

1. ``sketch``: per row the set's size, a 128-bit fingerprint, band keys (``BANDS`` of
   ``ROWS`` minima) and ``HASHES`` one-byte minima. Texts stay where they are; what is
   kept has a fixed size per row.
2. Equal sets are one class, named by the number of its first row. Copies are never paired.
3. Classes that share a band key are a bucket of candidates. Buckets are dealt in blocks
   of about ``BLOCK``, each of which is looked through once (``within``): signatures are
   compared batch by batch of ``BATCH`` minima, and a pair is pruned as soon as the
   posterior probability that it reaches the threshold is below ``MISS``. Of the pairs
   that stay a task gives a spanning forest, likeliest pairs first; a member that is very
   likely linked to one looked at before is not compared further. So a bucket of classes
   that are all alike costs a number of comparisons in proportion to its size.
4. Pairs are verified on the full shingle sets, and components follow.
5. A bucket that lies in one component is done. In the others the members outside the
   bucket's largest component are compared with all members of other components
   (``across``): first, for buckets of several blocks, for a spanning forest, then for all
   pairs that stay. So no link is lost but by the two stated probabilities (no shared
   band, pruned). Pairs within a component are never looked at again.

Comparisons are beyond proportion only where very many classes share a band and are not
linked, and verifications only where two large components stay just below the threshold.

Chances at a similarity of exactly 0.85: no band shared (1 - 0.85^5)^40 < 1e-10;
pruned: MISS for each batch; a band taken for shared: 40 / 2^32. At 0.8: 1.3e-7 for bands.
Shingles are compared by two independent 64-bit hashes.

Defined cases: null and empty texts, and texts of blanks, have an empty set, are linked
with nothing, and are their own component; rows of one doc_id are one document, whose
texts need not be equal: it is linked with all that any of its texts is linked with, and
n_shingles is that of each row's text; a null doc_id takes no part in links and is its
own (null) component; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components
from tidelog.llm.runtime import cut, map_in_arrow, table
from tidelog.llm.textkit import NOT_BLANK, Words, mix, shingles, slices

WIDTH = 5
PERCENT = 80
ROWS, BANDS = 5, 40
HASHES = 512
BATCH = 64
PAIRS = 65_536  # pairs that are compared at once
MISS = 1e-5
BLOCK = 1024
SMALL = 16  # buckets of up to so many members are compared all at once
STRONG = 0.03  # above the threshold by this estimate, a pair counts as linked until it is verified
PARTNERS = 512  # texts that one task verifies against another
BROADCAST_IDS = 500_000


def _family(seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    flips, factors = (rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) for _ in range(2))
    return flips, factors | np.uint32(1)


def set_minima(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes by row, and HASHES x n minima of the hash family over each row's values."""
    first = np.searchsorted(rows, np.arange(n + 1))
    full = np.flatnonzero(np.diff(first))
    low = np.full((HASHES, n), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    if len(full):
        short = (values >> np.uint64(32)).astype(np.uint32)
        for k, (flip, factor) in enumerate(zip(*_family(), strict=True)):
            low[k, full] = np.minimum.reduceat((short ^ flip) * factor, first[full])
    return np.diff(first), low


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """By row, the sum of values modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    first = np.searchsorted(rows, np.arange(n + 1))
    return total[first[1:]] - total[first[:-1]]


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tk, n_shingles, f1, f2, bands, signature) of each row of docs (doc_id, text, tk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                n = b - a
                rows, values = shingles(Words(texts.slice(a, n), NOT_BLANK), width)
                sizes, low = set_minima(rows, values, n)
                with np.errstate(over="ignore"):
                    prints = [_sums(rows, mix(values + np.uint64(k)), n).view(np.int64) for k in (1, 2)]
                    keys = np.zeros((n, BANDS), dtype=np.uint64)
                    for j in range(BANDS):
                        key = np.full(n, j, dtype=np.uint64)
                        for k in range(j * ROWS, (j + 1) * ROWS):
                            key = mix(key * np.uint64(31) + low[k])
                        keys[:, j] = key
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).reshape(-1))
                )
                small = np.concatenate(
                    [(low & np.uint32(255)).astype(np.uint8).T, (keys & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8)], axis=1
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, n),
                        batch.column("tk").slice(a, n),
                        pa.array(sizes, pa.int64()),
                        pa.array(prints[0]),
                        pa.array(prints[1]),
                        bands,
                        pa.array([r.tobytes() for r in small], pa.binary()),
                    ],
                    ["doc_id", "tk", "n_shingles", "f1", "f2", "bands", "signature"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tk long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary"
    return map_in_arrow(docs.select("doc_id", "text", "tk"), run, schema)


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """By batches compared: the fewest equal minima with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n equal) is the probability of at
    most m successes in n + 1 draws of chance t. One-byte minima of different
    elements are equal once in 256 times, which raises t a little.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return out


def staying_pairs(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (left, right), those never pruned, and their numbers of equal minima."""
    equal = np.zeros(len(left), dtype=np.int32)
    for k, least in enumerate(needed):
        part = signatures[:, k * BATCH : (k + 1) * BATCH]
        equal += (part[left] == part[right]).sum(axis=1, dtype=np.int32)
        stays = equal >= least
        left, right, equal = left[stays], right[stays], equal[stays]
        if not len(left):
            break
    return left, right, equal


def _root(up: dict, x):
    while (y := up.get(x, x)) != x:
        up[x] = up.get(y, y)
        x = y
    return x


class _Members:
    """Rows of buckets in a task: ids, components so far, signatures, and the band keys' marks."""

    def __init__(self, rows: pa.Table) -> None:
        self.id, self.label, self.band, self.side, self.minor, self.many = (
            rows.column(c).to_numpy() for c in ("node", "label", "band", "side", "minor", "many")
        )
        self.signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint8).reshape(len(self.id), HASHES + 4 * BANDS)
        self.mark = np.ascontiguousarray(self.signature[:, HASHES:]).view("<u4")

    def first_shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pairs share no band before that of their bucket."""
        earlier = np.arange(BANDS)[None, :] < self.band[left][:, None]
        return ~((self.mark[left] == self.mark[right]) & earlier).any(axis=1)

    def within(self, cuts: list[int], needed: list[int], strong: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Staying pairs (left, right, equal minima) of each block [cuts[k], cuts[k + 1])."""
        starts, sizes = np.array(cuts[:-1]), np.diff(cuts)
        found = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.int32),)]
        for size in range(2, SMALL + 1):
            i, j = np.triu_indices(size, 1)
            for own in np.array_split(starts[sizes == size], 1 + int((sizes == size).sum()) * len(i) // PAIRS):
                left, right = (own[:, None] + i).reshape(-1), (own[:, None] + j).reshape(-1)
                new = self.first_shared(left, right) | self.many[left]
                found.append(staying_pairs(self.signature, left[new], right[new], needed))
        for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            tree = np.arange(n)
            for i in range(n - 1):
                others = i + 1 + np.flatnonzero(tree[i + 1 :] != tree[i])
                left, right = np.full(len(others), a + i), a + others
                if not self.many[a]:
                    new = self.first_shared(left, right)
                    left, right = left[new], right[new]
                found.append(staying_pairs(self.signature, left, right, needed))
                same = found[-1][1][found[-1][2] >= strong] - a
                if len(same):
                    tree[np.isin(tree, tree[same])] = tree[i]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def across(self, cuts: list[int], needed: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Staying pairs between the members outside the bucket's largest component (side 1) and all of other components."""
        found = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.int32),)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            every = a + np.flatnonzero(self.side[a:b] == 0)
            for i in (a + np.flatnonzero(self.side[a:b] == 1)).tolist():
                right = every[(self.label[every] != self.label[i]) & (~self.minor[every] | (self.id[every] > self.id[i]))]
                left = np.full(len(right), i)
                new = self.first_shared(left, right)
                found.append(staying_pairs(self.signature, left[new], right[new], needed))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def forest(self, left: np.ndarray, right: np.ndarray, equal: np.ndarray) -> list[tuple[int, int]]:
        """Of the pairs, by id, those that join the components so far, likeliest first."""
        out, up = [], {}
        for k in np.lexsort((self.id[right], self.id[left], -equal)).tolist():
            a, b = _root(up, self.label[left[k]]), _root(up, self.label[right[k]])
            if a != b:
                up[a] = b
                out.append((int(self.id[left[k]]), int(self.id[right[k]])))
        return out


def candidate_pairs(members: DataFrame, percent: int, across: bool, all_pairs: bool) -> DataFrame:
    """(a, b), a < b, distinct, of members (key, p, q, side, minor, many, band, node, label, signature) dealt by (key, p, q)."""
    needed = least_matches(percent)
    sure = min(1.0, percent / 100 + STRONG)
    strong = math.ceil(HASHES * (sure + (1 - sure) / 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            block = pa.Table.from_batches([batch])
            rest = block if rest is None else pa.concat_tables([rest, block])
            keys = [rest.column(c).to_numpy() for c in ("key", "p", "q")]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(edge):
                done, rest = rest.slice(0, int(edge[-1])), rest.slice(int(edge[-1]))
                yield from compare(done, edge[:-1])
        if rest is not None and len(rest):
            yield from compare(rest, np.zeros(0, dtype=np.int64))

    def compare(rows: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, cuts = _Members(rows), [0, *edges.tolist(), len(rows)]
        left, right, equal = own.across(cuts, needed) if across else own.within(cuts, needed, strong)
        both = np.stack([own.id[left], own.id[right]], axis=1) if all_pairs else np.array(own.forest(left, right, equal), dtype=np.int64).reshape(-1, 2)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], ["a", "b"])

    dealt = members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return map_in_arrow(dealt, run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough; texts: (node, text).

    A pair goes to its first node, salted by the second, so that a node with very many
    pairs is spread over tasks of about ``PARTNERS``; each salt gets the first node's text once.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("salts"))
    dealt = pairs.join(counts.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    roles = dealt.select("a", "salt", F.lit(False).alias("second"), F.col("a").alias("node")).distinct().union(
        dealt.select("a", "salt", F.lit(True), "b")
    )
    rows = roles.join(texts.hint("merge"), "node").select("a", "salt", "second", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            firsts, salts, seconds, nodes = (batch.column(c).to_pylist() for c in ("a", "salt", "second", "node"))
            texts, good = batch.column("text"), []
            for x, y in slices(texts):
                words = Words(texts.slice(x, y - x), NOT_BLANK)
                sets = [shingles(words, width, seed) for seed in (0, 1)]
                first = [np.searchsorted(rows, np.arange(y - x + 1)) for rows, _ in sets]
                for i in range(x, y):
                    mine = [values[f[i - x] : f[i - x + 1]] for (_, values), f in zip(sets, first, strict=True)]
                    if not seconds[i]:
                        at, own = (firsts[i], salts[i]), mine
                    elif at == (firsts[i], salts[i]) and len(mine[0]):
                        both = min(len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(own, mine, strict=True))
                        if 100 * both >= percent * (max(map(len, own)) + max(map(len, mine)) - both):
                            good.append((firsts[i], nodes[i]))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["a", "b"])

    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "second")
    return map_in_arrow(ordered, run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id long, text)."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    sketches = cut(sketch(keyed, width).withColumn("node", F.monotonically_increasing_id()))
    held = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(held.groupBy("f1", "f2").agg(F.min("node").alias("node")))

    spread = held.join(classes.select("node"), "node").select("node", F.posexplode("bands").alias("band", "key"))
    shared = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(spread.join(shared, "key").select("key", "band", "node", "n"))
    involved = cut(members.select("node").distinct())
    few = involved.count() <= BROADCAST_IDS
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    signatures = cut(held.select("node", "doc_id", "tk", "signature").join(near(involved), "node"))
    places = signatures.select("node", "doc_id", "tk")
    texts = cut(keyed.join(near(places), ["doc_id", "tk"]).select("node", "text").dropDuplicates(["node"]))

    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    hashed = lambda n, seed: F.pmod(F.xxhash64("node", "key", F.lit(seed)), n).cast("int")

    def links(dealt: DataFrame, across: bool, all_pairs: bool) -> DataFrame:
        pairs = cut(candidate_pairs(dealt.join(signatures.select("node", "signature").hint("merge"), "node"), percent, across, all_pairs))
        return cut(verified(pairs, texts, width, percent))

    def open_buckets(labels: DataFrame) -> DataFrame:
        """Members of the buckets that lie in several components, with the sizes of the bucket and of what is outside its largest one."""
        tagged = cut(members.join(labels.hint("merge"), "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("label")))
        parts = tagged.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        keys = parts.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("major"))
        keys = cut(keys.filter("most < n"))
        return tagged.join(keys.hint("merge"), "key").select("key", "band", "node", "label", "n", (F.col("n") - F.col("most")).alias("m"), (F.col("label") != F.col("major")).alias("minor"))

    def facing(rows: DataFrame) -> DataFrame:
        """All members of each bucket by blocks p, against those outside its largest component by blocks q."""
        nb, mb = blocks(F.col("n")), blocks(F.col("m"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rest = [F.lit(False).alias("many"), "minor", "band", "node", "label"]
        every = rows.select("key", hashed(nb, 0).alias("p"), upto(mb).alias("q"), F.lit(0).alias("side"), *rest)
        return every.union(rows.filter("minor").select("key", upto(nb).alias("p"), hashed(mb, 1).alias("q"), F.lit(1).alias("side"), *rest))

    no = F.lit(False)
    nb = blocks(F.col("n"))
    edges = links(
        members.select("key", hashed(nb, 0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), (nb > 1).alias("many"), no.alias("minor"), "band", "node", F.col("node").alias("label")),
        across=False,
        all_pairs=False,
    )
    rows = cut(open_buckets(connected_components(edges)))
    if not (large := rows.filter(F.col("n") > BLOCK)).isEmpty():
        edges = edges.union(links(facing(large), across=True, all_pairs=False))
        rows = cut(open_buckets(connected_components(edges)))
    if not rows.isEmpty():
        edges = edges.union(links(facing(rows), across=True, all_pairs=True))

    # the rows of a doc_id are one document, whatever its texts
    filed = cut(sketches.filter("doc_id is not null").select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left").select("doc_id", "node"))
    owners = filed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    same = filed.join(owners.filter("a < z").select("doc_id", "a"), "doc_id").filter("node > a").select("a", F.col("node").alias("b"))
    components = connected_components(edges.union(same))
    placed = cut(owners.join(components.hint("merge"), owners["a"] == components["node"], "left").select("doc_id", F.coalesce("component", "a").alias("component")))
    least = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = placed.join(least.hint("merge"), "component", "left").select("doc_id", F.coalesce("least", "doc_id").alias("component_id"))
    return sketches.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", "component_id")


def deduplicate(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of docs of one document of each component: that of the least doc_id, once.

    Of several rows of that doc_id the one with the least text stays. Rows without a
    doc_id are all kept. Texts are only shuffled if very many documents go.
    """
    found = cut(near_duplicates(docs.filter("doc_id is not null"), percent, width).select("doc_id", "component_id"))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    again = cut(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    leave = cut(gone.union(again))
    near = F.broadcast(leave) if leave.count() <= BROADCAST_IDS else leave
    once = docs.join(near, "doc_id", "left_anti").select(*docs.columns)  # a null doc_id is in no list
    if again.isEmpty():
        return once
    first = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row"))
    return once.union(first.select("row.*"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[a:a + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS a FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT i.a, i.b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) i
  JOIN sizes p ON p.doc_id = i.a JOIN sizes q ON q.doc_id = i.b
  WHERE 100 * i.c >= 85 * (p.n + q.n - i.c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.c AS component_id, d.doc_id = l.c AS kept
FROM documents d JOIN least l ON l.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
