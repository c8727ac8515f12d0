"""Nearest neighbours by largest inner product, from a hierarchical k-means tree.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the
largest inner product is the smallest distance. The tree's upper part is fitted on the
driver to about ``SAMPLE`` vectors (by a hash of vec_id); every vector is filed in one of
its leaves. A leaf that then holds more than ``GRAFT`` vectors gets a subtree, fitted on
an executor to about ``GRAFT`` of its own vectors, so that the number of leaves grows with
the table, to ``SAMPLE / LEAF * GRAFT / LEAF`` or so; the driver gets centres only. A query
walks the whole tree best bin first: a priority queue gives the unexplored branch whose
centre is nearest, until the leaves visited hold enough candidates, and k + 1 at least.

How many are enough is calibrated on the whole table: the true neighbours of about
``PROBES`` queries are found by brute force, block by block, and visits are widened until
``RECALL`` of them lie in the leaves visited. The measured recall is in the README.

Scale: leaves next to each other in the tree form bins of about ``BIN`` vectors (a larger
leaf is a bin of its own, dealt in blocks), against blocks of about ``QUERY_BLOCK``
queries, so that one leaf may hold a third of all vectors. A query goes to a bin once,
with the leaves of it that it visits. A block gives its best ``k`` per query; Spark keeps
the best ``k`` of these. The driver holds the sample, the centres and counts by leaf.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, as query or candidate, nor do those whose dimension is not the most
frequent one (the larger of equals); rows of one vec_id are one vector, the least of
theirs in array order; ties in score go to the smaller vec_id; a query gets k results, or
all candidates if fewer; an empty table, or no query, gives no rows; columns other than
the two named are not looked at.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.runtime import cut, map_in_arrow, share, table

K = 20
SAMPLE = 20_000
BRANCH = 4
LEAF = 128
RECALL = 0.97
PROBES = 300
BIN = BLOCK = 4096
GRAFT = 4096
QUERY_BLOCK = 1024
PAIRS = 65_536  # pairs of a block that are scored at once
HELD = 400_000  # results that a task holds back to keep the best of them


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)


class Tree:
    """Centres of all nodes; ``children`` by node, empty for a leaf; ``leaf`` numbers the leaves."""

    def __init__(self, points: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.centres = [points.mean(axis=0)] if len(points) else [np.zeros(points.shape[1])]
        self.children: list[list[int]] = [[]]
        todo = [(0, np.arange(len(points)))]
        for node, own in todo:
            if len(own) <= LEAF:
                continue
            parts = self._split(points[own], rng)
            if len(parts) < 2:
                continue
            for part in parts:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), own[part]))
                self.centres.append(points[own[part]].mean(axis=0))
                self.children.append([])
        self.centres = np.array(self.centres)
        self._number()

    def _number(self) -> None:
        """Leaves are numbered from left to right, so that near numbers are near in the tree."""
        self.leaf, todo = {}, [0]
        while todo:
            n = todo.pop()
            if self.children[n]:
                todo.extend(reversed(self.children[n]))
            else:
                self.leaf[n] = len(self.leaf)

    def grafted(self, parts: dict[int, Tree]) -> Tree:
        """This tree with subtrees (their roots' centres replaced by the leaves') in place of leaves, by leaf number."""
        out = Tree.__new__(Tree)
        node_of = {k: n for n, k in self.leaf.items()}
        centres, out.children = [self.centres], [list(c) for c in self.children]
        for number, part in sorted(parts.items()):
            shift = len(out.children) - 1  # node 0 of the part is the leaf itself
            out.children += [[c + shift for c in own] for own in part.children[1:]]
            out.children[node_of[number]] = [c + shift for c in part.children[0]]
            centres.append(part.centres[1:])
        out.centres = np.concatenate(centres)
        out._number()
        return out

    @staticmethod
    def _split(points: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        kinds = np.unique(points, axis=0)
        if len(kinds) < 2:
            return []
        centres = kinds[rng.choice(len(kinds), min(BRANCH, len(kinds)), replace=False)]
        for _ in range(12):
            nearest = _distances(points, centres).argmin(axis=1)
            moved = np.array([points[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
            if np.allclose(moved, centres):
                break
            centres = moved
        nearest = _distances(points, centres).argmin(axis=1)
        return [np.flatnonzero(nearest == k) for k in range(len(centres)) if (nearest == k).any()]

    def file(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down the nearest centres."""
        at = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = [n for n in np.unique(at).tolist() if self.children[n]]
            if not inner:
                return np.array([self.leaf[n] for n in at.tolist()], dtype=np.int64)
            for n in inner:
                own = np.flatnonzero(at == n)
                kids = np.array(self.children[n])
                at[own] = kids[_distances(points[own], self.centres[kids]).argmin(axis=1)]

    def visits(self, points: np.ndarray, held: np.ndarray, enough: int) -> Iterator[list[int]]:
        """By query, the leaves of its walk, best bin first, until they hold ``enough`` of the vectors that ``held`` counts by leaf."""
        for a in range(0, len(points), 256):
            for row in _distances(points[a : a + 256], self.centres).tolist():
                queue, found, size = [(row[0], 0)], [], 0
                while queue and size < enough:
                    _, n = heapq.heappop(queue)
                    while self.children[n]:  # down to the nearest leaf; the branches not taken wait
                        kids = sorted((row[c], c) for c in self.children[n])
                        for kid in kids[1:]:
                            heapq.heappush(queue, kid)
                        n = kids[0][1]
                    found.append(self.leaf[n])
                    size += int(held[found[-1]])
                yield found


def calibrate(tree: Tree, held: np.ndarray, probes: np.ndarray, wanted: list[list[int]], target: float) -> int:
    """The fewest candidates with which the probes' walks reach ``target`` of the leaves of their true neighbours."""
    needed = []
    for order, leaves in zip(tree.visits(probes, held, int(held.sum()) + 1), wanted, strict=True):
        before = dict(zip(order, np.cumsum(np.append(0, held[order]))[:-1].tolist(), strict=True))
        needed += [before[leaf] + 1 for leaf in leaves]  # a walk goes on until it holds so many
    return int(np.quantile(needed, target, method="higher")) if needed else 1


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, with components as given."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    good = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & some
    )
    sizes = good.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    good = good.filter(F.size("embedding") == (top["size"] if top else 0))
    again = cut(good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"))
    if again.isEmpty():
        return good
    first = good.join(again, "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return good.join(again, "vec_id", "left_anti").union(first)


def _best(query_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, open_: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, candidate's place, score) arrays of at least the k best candidates of each query; ``open_``: which may be looked at."""
    m = min(k + 1, len(ids))  # one of them may be the query
    step = max(1, PAIRS // len(ids))
    for a in range(0, len(query_ids), step):
        q = query_ids[a : a + step]
        rough = asked[a : a + step] @ own.T
        if open_ is not None:
            rough[~open_[a : a + step]] = -np.inf
        edge = np.partition(rough, len(ids) - m, axis=1)[:, len(ids) - m]
        edge = np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), np.finfo(np.float64).min)
        row, col = np.nonzero(rough >= edge[:, None])
        other = ids[col] != q[row]
        row, col = row[other], col[other]
        # one way of adding for all, so that equal vectors tie
        yield q[row], col, (own[col] * asked[a : a + step][row]).sum(axis=1)


def _trimmed(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of all that was found (query, candidate, score, ...), the k best of each query."""
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    q, v, score = columns[:3]
    order = np.lexsort((v, -score, q))
    q = q[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return tuple(c[order][place < k] for c in columns)


def true_neighbours(filed: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, leaf) of the k nearest of all filed vectors (vec_id, embedding, leaf), for some queries, by brute force."""
    shared = share(filed.sparkSession, (ids, probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ids, asked = shared.value
        held = None
        for batch in batches:
            own, places = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            new = [(q, own[col], score, places[col]) for q, col, score in _best(asked_ids, asked, own, _matrix(batch.column("embedding")), k)] if len(own) else []
            held = _trimmed([*([held] if held else []), *new], k) if held or new else None
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["query_id", "vec_id", "score", "leaf"])

    found = map_in_arrow(filed, run, "query_id long, vec_id long, score double, leaf int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "leaf")


def graft(tree: Tree, filed: DataFrame, norm: float) -> Tree:
    """The tree with subtrees for its large leaves, fitted on the executors to bounded samples of them."""
    counts = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = {k: n for k, n in counts.items() if n > GRAFT}
    if not large:
        return tree
    steps = 1 << 24
    share_of = F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, int(steps * GRAFT / n) + 1)])
    sampled = filed.filter(F.col("leaf").isin(list(large)) & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(steps)) < share_of[F.col("leaf")]))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            points, leaves = _lift(_matrix(batch.column("embedding")), norm), batch.column("leaf").to_numpy()
            for leaf in np.unique(leaves).tolist():
                held.setdefault(leaf, []).append(points[leaves == leaf])
        for leaf, parts in held.items():
            points = np.concatenate(parts)
            part = Tree(points[np.lexsort(points.T)], seed=leaf)
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([pickle.dumps(part)], pa.binary())], ["leaf", "tree"])

    parts = map_in_arrow(sampled.repartition(len(large), "leaf"), fit, "leaf int, tree binary").collect()
    return tree.grafted({r["leaf"]: pickle.loads(bytes(r["tree"])) for r in parts})


def nearest(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the usable vectors (vec_id long, embedding) for which ``is_query`` holds."""
    good = usable(vectors)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, norm = good.agg(F.count(F.lit(1)), F.max(squares)).first()
    empty = good.select(
        F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
    ).filter(F.lit(False))
    if not count:
        return empty
    norm = float(np.sqrt(norm))
    steps = 1 << 24
    share_of = min(steps, int(steps * sample / count) + 1)
    rows = good.filter(F.pmod(F.xxhash64("vec_id"), F.lit(steps)) < share_of).collect()
    rows = sorted((r["vec_id"], r["embedding"]) for r in rows)
    matrix = np.array([v for _, v in rows], dtype=np.float64) if rows else np.array([good.first()["embedding"]], dtype=np.float64)
    tree = Tree(_lift(matrix, norm))
    doubles = good.select("vec_id", F.col("embedding").cast("array<double>"))
    kinds = "vec_id long, embedding array<double>, leaf int"

    def filed_in(own: Tree, vectors: DataFrame) -> DataFrame:
        shared = share(good.sparkSession, own)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaves = shared.value.file(_lift(_matrix(batch.column("embedding")), norm))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("embedding"), pa.array(leaves, pa.int32())], ["vec_id", "embedding", "leaf"]
                )

        return cut(map_in_arrow(vectors, file, kinds))

    filed = filed_in(tree, doubles)
    whole = graft(tree, filed, norm)
    if whole is not tree:
        tree, filed = whole, filed_in(whole, filed.select("vec_id", "embedding"))
    held = np.zeros(len(tree.leaf), dtype=np.int64)
    for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["leaf"]] = r["n"]

    asked = filed.filter(is_query)
    queries_in_all = asked.count()
    if not queries_in_all:
        return empty
    share_of = min(steps, int(steps * PROBES / queries_in_all) + 1)
    probes = sorted((r["vec_id"], r["embedding"]) for r in asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(steps)) < share_of).collect())
    enough = 1
    if probes:
        probe_ids, points = np.array([i for i, _ in probes], dtype=np.int64), np.array([v for _, v in probes], dtype=np.float64)
        wanted: dict[int, list[int]] = {int(i): [] for i in probe_ids}
        for r in true_neighbours(filed, probe_ids, points, k).collect():
            wanted[r["query_id"]].append(r["leaf"])
        enough = calibrate(tree, held, np.hstack([points, np.zeros((len(points), 1))]), list(wanted.values()), recall)
    enough = max(enough, k + 1)

    # bins of leaves that lie next to each other
    bin_of, filled = np.zeros(len(held), dtype=np.int32), 0
    for leaf in range(1, len(held)):
        filled += int(held[leaf - 1])
        full = filled + int(held[leaf]) > BIN
        bin_of[leaf], filled = bin_of[leaf - 1] + full, 0 if full else filled
    shared = share(good.sparkSession, (tree, held, bin_of))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, bins = shared.value
        for batch in batches:
            points = _matrix(batch.column("embedding"))
            for r, found in enumerate(own.visits(np.hstack([points, np.zeros((len(points), 1))]), counts, enough)):
                leaves = np.sort(np.array(found, dtype=np.int32))
                into, first = np.unique(bins[leaves], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(leaves)), pa.int32()), pa.array(leaves))
                one = pa.array(np.full(len(into), r))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(one), batch.column("embedding").take(one), pa.array(into), lists], ["vec_id", "embedding", "bin", "leaves"]
                )

    routed = cut(map_in_arrow(asked.select("vec_id", "embedding"), route, "vec_id long, embedding array<double>, bin int, leaves array<int>"))
    asked_of = {r["bin"]: -(-r["n"] // QUERY_BLOCK) for r in routed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_vectors = {b: -(-int(n) // BLOCK) for b, n in enumerate(np.bincount(bin_of, weights=held)) if b in asked_of}
    spark = good.sparkSession
    sizes = F.broadcast(_numbers(spark, {b: (nv, asked_of[b]) for b, nv in of_vectors.items() if nv}))
    bins_of = F.broadcast(_numbers(spark, {leaf: (int(b), 0) for leaf, b in enumerate(bin_of.tolist())}).select(F.col("key").alias("leaf"), F.col("x").alias("bin")))
    hashed = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = filed.join(bins_of, "leaf").join(sizes, F.col("bin") == F.col("key")).select(
        "bin", hashed(F.col("x"), 1).alias("vb"), upto("y").alias("qb"), F.lit(1).alias("part"), "vec_id", "embedding", F.array("leaf").alias("leaves")
    )
    queries = routed.join(sizes, F.col("bin") == F.col("key")).select(
        "bin", upto("x").alias("vb"), hashed(F.col("y"), 2).alias("qb"), F.lit(0).alias("part"), "vec_id", "embedding", "leaves"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found, size = None, [], 0
        for batch in batches:
            more = pa.Table.from_batches([batch])
            rest = more if rest is None else pa.concat_tables([rest, more])
            keys = [rest.column(c).to_numpy() for c in ("bin", "vb", "qb")]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            cuts = [0, *edges.tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for part in one(rest.slice(a, b - a)):
                    found.append(part)
                    size += len(part[0])
                    if size > HELD:
                        found = [_trimmed(found, k)]
                        size = len(found[0][0])
                        if size > HELD // 2:
                            yield out_of(found[0])
                            found, size = [], 0
            rest = rest.slice(cuts[-1])
        if rest is not None and len(rest):
            found += one(rest)
        if found:
            yield out_of(_trimmed(found, k))

    def out_of(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["query_id", "vec_id", "score"])

    def one(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        part, ids = rows.column("part").to_numpy(), rows.column("vec_id").to_numpy()
        if part.min() == part.max():
            return
        matrix = _matrix(rows.column("embedding").combine_chunks())
        lists = rows.column("leaves").combine_chunks()
        own, asked = np.flatnonzero(part == 1), np.flatnonzero(part == 0)
        names, leaf = np.unique(lists.take(pa.array(own)).flatten().to_numpy(), return_inverse=True)
        visited = lists.take(pa.array(asked))
        row, which = pc.list_parent_indices(visited).to_numpy(), visited.flatten().to_numpy()
        at = np.minimum(np.searchsorted(names, which), len(names) - 1)
        known = names[at] == which
        open_ = np.zeros((len(asked), len(names)), dtype=bool)
        open_[row[known], at[known]] = True
        for a in range(0, len(asked), 64):
            for q, col, score in _best(ids[asked[a : a + 64]], matrix[asked[a : a + 64]], ids[own], matrix[own], k, open_[a : a + 64][:, leaf.reshape(-1)]):
                yield q, ids[own][col], score

    dealt = candidates.union(queries).repartition("bin", "vb", "qb").sortWithinPartitions("bin", "vb", "qb")
    pairs = map_in_arrow(dealt, compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _numbers(spark: SparkSession, numbers: dict[int, tuple[int, int]]) -> DataFrame:
    """(key, x, y): a small table of numbers by leaf or bin."""
    return spark.createDataFrame([(int(a), int(x), int(y)) for a, (x, y) in numbers.items()], "key int, x int, y int")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
