"""Best overlaps of gram sets: batches of texts against a fixed list of queries, by arrays.

The grams of a text are those of ``functions.text.grams``. Counts of shared grams are kept
for all queries at once and only while a batch is looked at, so that no pair is written.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidelog.functions.text import PAD

#: Grams x queries of one index, and letters and counts that are looked at together.
CELLS, LETTERS, COUNTS = 1 << 25, 1 << 18, 1 << 20

#: (ids of the queries, sizes of their sets, grams, for each gram of a query: place of the gram, place of the query)
Index = tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]


def indexes(queries: Iterable[tuple[int, str]], n: int, cells: int) -> Iterator[Index]:
    """Indexes of all (id, normal text), each of at most ``cells`` or of one query."""
    ids, sizes, at, of, seen = [], [], [], [], {}
    for i, text in queries:
        padded = PAD * (n - 1) + text + PAD * (n - 1)
        own = {padded[k : k + n] for k in range(len(padded) - n + 1)}
        if ids and (len(seen) + len(own)) * (len(ids) + 1) > cells:
            yield _packed(ids, sizes, seen, at, of)
            ids, sizes, at, of, seen = [], [], [], [], {}
        at += [seen.setdefault(g, len(seen)) for g in own]
        of += [len(ids)] * len(own)
        ids.append(i)
        sizes.append(len(own))
    if ids:
        yield _packed(ids, sizes, seen, at, of)


def _packed(ids: list, sizes: list, seen: dict, at: list, of: list) -> Index:
    return np.array(ids, np.int64), np.array(sizes, np.int64), list(seen), np.array(at, np.int32), np.array(of, np.int32)


class Best:
    """The best records of each query of an index, batch by batch.

    ``of`` gives a batch's rows that can be among the ``limit`` best records of a query: no
    more than ``limit`` records of the batch, and none below ``limit`` records of an earlier one
    (where the ids are of a nested type, all that reach ``amount``).
    """

    def __init__(self, index: Index, n: int, amount: float, limit: int):
        self.ids, self.sizes, grams, at, of = index
        self.n, self.limit = n, limit
        self.letters = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).T
        # lanes of words: four or two counts are added by one addition, and none can overflow
        self.lane = np.uint16 if self.sizes.max() < 1 << 16 else np.uint32
        self.wide = -(-len(self.ids) // 4) * 4
        table = np.zeros((len(grams), self.wide), self.lane)
        table[at, of] = 1
        self.table = table.view(np.uint64)
        self.least = np.full(len(self.ids), float(amount))
        self.rank = np.zeros(0x110000, np.int64)

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of the gram sets of texts, and the owner and place in the index of each gram that is there, by owner."""
        n, pads = self.n, PAD * (self.n - 1)
        # neighbours share their pads: each window that starts from a text's first pad to its last letter is one of its own
        letters = np.frombuffer((pads + pads.join(texts) + pads).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(x) + n - 1 for x in texts])
        there = np.zeros(0x110000, bool)
        there[letters] = there[self.letters] = True
        alphabet = np.flatnonzero(there)
        self.rank[alphabet] = np.arange(len(alphabet))
        keys, span = np.zeros(len(owner) + self.letters.shape[1], np.int64), 1
        for k in range(n):
            keys = keys * len(alphabet) + self.rank[np.concatenate([letters[k : k + len(owner)], self.letters[k]])]
            span *= len(alphabet)
            if span * max(len(alphabet), len(texts)) >= 1 << 62:
                distinct, keys = np.unique(keys, return_inverse=True)
                span = len(distinct)
        known = np.argsort(keys[len(owner) :])
        ordered = keys[len(owner) :][known]
        found = owner * span + keys[: len(owner)]
        found.sort()
        found = found[np.flatnonzero(np.diff(found, prepend=-1))]
        owner = found // span
        gram = found - owner * span
        place = np.minimum(np.searchsorted(ordered, gram), len(ordered) - 1)
        hit = np.flatnonzero(ordered[place] == gram)
        return np.bincount(owner, minlength=len(texts)), owner[hit], known[place[hit]]

    def scored(self, texts: list[str], record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, record, score) of pairs of texts and queries that share a gram and reach what the query asks for."""
        size, owner, place = self.sets(texts)
        hits = np.bincount(owner, minlength=len(texts))
        # no query can share more than these, and the union has all grams of the text
        can = (hits > 0) & (np.minimum(hits, self.sizes.max()) / size >= self.least.min())
        keep = can[owner]
        place, texts_left = place[keep], np.flatnonzero(can)
        ends = np.cumsum(hits[texts_left])
        out = []
        step = max(1, 4 * COUNTS // self.wide)
        first = 0
        while first < len(texts_left):
            start = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + step, "right")))
            starts = np.concatenate([[start], ends[first : last - 1]]) - start
            both = np.add.reduceat(self.table[place[start : ends[last - 1]]], starts, axis=0).view(self.lane)[:, : len(self.ids)].astype(np.int64)
            own = texts_left[first:last]
            score = both / (size[own][:, None] + self.sizes - both)
            row, query = np.nonzero((score >= self.least) & (both > 0))
            out.append((query, record[own[row]], score[row, query]))
            first = last
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def leading(self, query: np.ndarray, record: np.ndarray, score: np.ndarray, ranked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each record once for a query, by its best score, and of each query the first records; all of them where rows are not known to be records of their own."""
        if not ranked:
            return query, record, score
        order = np.lexsort((-score, record, query))
        query, record, score = query[order], record[order], score[order]
        once = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(record, prepend=-1) != 0))
        query, record, score = query[once], record[once], score[once]
        order = np.lexsort((record, -score, query))
        query, record, score = query[order], record[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        full = nth == self.limit - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        keep = nth < self.limit
        return query[keep], record[keep], score[keep]

    def of(self, ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(query, record, score) of a batch's records by id, of which several may be of one record."""
        try:
            coded = ids.dictionary_encode(null_encoding="encode")
            order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            record, kinds, ranked = rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order)), True
        except (pa.ArrowNotImplementedError, pa.ArrowTypeError):  # ids of nested types
            record, kinds, ranked = np.arange(len(ids)), ids, False
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        words = [x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()]
        first, most = 0, max(1, COUNTS // self.wide)
        while first < len(words):
            last, letters = first, 0
            while last < len(words) and last - first < most and (last == first or letters + len(words[last]) <= LETTERS):
                letters += len(words[last])
                last += 1
            new = self.scored(words[first:last], record[first:last])
            if len(new[0]):
                best = self.leading(*(np.concatenate(x) for x in zip(best, new)), ranked)
            first = last
        return self.ids[best[0]], kinds.take(pa.array(best[1])), best[2]
