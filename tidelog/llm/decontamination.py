"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts and items are normalised to words: A-Z lower-cased, then
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The automaton is built over item words, one
path per item, so that no match runs across items. Streaming a document's words
through it gives, at each word, the length of the longest match that ends there; a
window (``window`` words of an item, or all words of a shorter item) ends there when
the matched state, or a suffix of it, is marked with that window. Words inside an
occurrence of a window are hit. Spans that reach the length limit are removed, and a
document is contaminated when enough items occur in it or hits cover enough of it.

A step from one word to the next can only lengthen a match if the two words stand
next to each other in some item. Documents are therefore cut, exactly, where they
do not; pieces too short for the shortest window are left out, and all other pieces
of a batch walk the automaton in step, as NumPy arrays.

Words are looked up by hash; the words of every hit are then compared byte by byte, and
a seed is taken under which no two words of the items share a hash.

Scale: documents are read once, in a narrow stage, without a shuffle. The items'
size is counted first; beyond ``SHARD_BYTES`` they are split over several automata (by
item), each of which is shipped and walked in its own pass; what a pass gives is
written before the next one, so that the driver and a worker hold one automaton at a
time (some 150 MB for a full shard). One item longer than that is a shard of its own.

Defined cases: null or empty texts have no words and no hits; items without words
have no window, nor have items without an id; items of equal text all count, rows of one
item_id are one item; rows of one doc_id are judged one by one; an empty benchmark or
document table gives no hits or no rows; other columns pass through, whatever their
names; those that ``contamination`` (its ``names``) and ``decontaminate`` (n_removed)
set are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.runtime import free_names, map_in_arrow, share, store, table
from tidelog.llm.textkit import ALNUM, Words, slices

WINDOW = 8
MIN_ITEMS = 2
SHARD_BYTES = 1 << 20
NAMES = ("n_words", "spans", "items")


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, as sorted transition arrays."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        """items: (item_id as string, its word numbers)."""
        step: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def extend(last: int, c: int) -> int:
            if (q := step[last].get(c)) is not None:
                if length[q] == length[last] + 1:
                    return q
                return split(last, q, c)
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, q, c)
            return new

        def split(p: int, q: int, c: int) -> int:
            copy = len(step)
            step.append(dict(step[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = copy
            while p != -1 and step[p].get(c) == q:
                step[p][c] = copy
                p = link[p]
            return copy

        for _, words in items:
            last = 0
            for c in words:
                last = extend(last, c)

        self.link, self.length = np.array(link), np.array(length)
        keys = [(s << 32) | c for s, out in enumerate(step) for c in out]
        to = [t for out in step for t in out.values()]
        order = np.argsort(np.array(keys, dtype=np.int64)) if keys else np.zeros(0, dtype=np.int64)
        self.keys, self.to = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order]

        # the state of each window, and the items that have it
        marks: dict[tuple[int, int], set[int]] = {}
        for number, (_, words) in enumerate(items):
            width = min(window, len(words))
            for a in range(len(words) - width + 1 if width else 0):
                state = 0
                for c in words[a : a + width]:
                    state = step[state][c]
                marks.setdefault((state, width), set()).add(number)
        self.ids = [item for item, _ in items]
        self.shortest = min((w for _, w in marks), default=0)
        # by state: the windows that end wherever the state is matched with length >= their width
        own: dict[int, list[int]] = {}
        self.widths, self.owners = [], []
        for (state, width), numbers in marks.items():
            own.setdefault(state, []).append(len(self.widths))
            self.widths.append(width)
            self.owners.append(sorted(numbers))
        every: dict[int, tuple[int, ...]] = {0: tuple(own.get(0, ()))}
        for s in np.argsort(self.length, kind="stable").tolist():
            if s:
                every[s] = tuple(own.get(s, ())) + every[link[s]]
        self.windows_of = every
        self.marked = np.array([bool(every[s]) for s in range(len(step))])

    def follow(self, state: np.ndarray, word: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word further for many walkers: next states and matching lengths."""
        state, matched = state.copy(), matched.copy()
        out = np.zeros_like(state)
        left = np.arange(len(state))
        while len(left):
            key = (state[left] << 32) | word[left]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            found = self.keys[at] == key
            done = left[found]
            out[done] = self.to[at[found]]
            matched[done] += 1
            left = left[~found]
            back = self.link[state[left]]
            ended = back < 0
            matched[left[ended]] = 0
            left, back = left[~ended], back[~ended]
            state[left] = back
            matched[left] = self.length[back]
        return out, matched


class Index:
    """An automaton with the vocabulary and word pairs of its items; what a worker needs."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        spelled = [words.word(k) for k in range(len(words))]
        for self.seed in count():
            self.vocabulary, first, numbers = np.unique(words.hashes(self.seed), return_index=True, return_inverse=True)
            numbers = numbers.reshape(-1).astype(np.int64)
            self.spelling = [spelled[k] for k in first.tolist()]
            if all(w == self.spelling[n] for w, n in zip(spelled, numbers.tolist(), strict=True)):
                break
        cut = [numbers[words.first[i] : words.first[i + 1]].tolist() for i in range(len(items))]
        self.automaton = SuffixAutomaton([(i, w) for (i, _), w in zip(items, cut, strict=True)], window)
        self.pairs = np.unique(np.array([(a << 32) | b for w in cut for a, b in zip(w, w[1:], strict=False)], dtype=np.int64))

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the last word, width, mark) of every window that occurs in the texts of ``words``."""
        none = (np.zeros(0, dtype=np.int64),) * 3
        if not len(words) or not len(self.vocabulary) or not self.automaton.shortest:
            return none
        h = words.hashes(self.seed)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[at] == h, at, -1).astype(np.int64)
        known = number >= 0
        joined = known[1:] & known[:-1] & (words.row[1:] == words.row[:-1])
        if len(self.pairs):
            where = np.flatnonzero(joined)
            key = (number[where] << 32) | number[where + 1]
            spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[where[self.pairs[spot] != key]] = False
        else:
            joined[:] = False
        begins = known.copy()
        begins[1:] &= ~joined
        ends = known.copy()
        ends[:-1] &= ~joined
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = stop - start >= self.automaton.shortest
        start, stop = start[long], stop[long]
        order = np.argsort(start - stop, kind="stable")
        start, stop = start[order], stop[order]
        lengths = stop - start
        state, matched = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        last, marks = [], []
        live, k = len(start), 0
        while live:
            live = int(np.searchsorted(-lengths, -k, side="left"))
            if not live:
                break
            state[:live], matched[:live] = self.automaton.follow(state[:live], number[start[:live] + k], matched[:live])
            hit = np.flatnonzero(self.automaton.marked[state[:live]])
            for w in hit.tolist():
                for m in self.automaton.windows_of[int(state[w])]:
                    if self.automaton.widths[m] <= matched[w]:
                        last.append(start[w] + k)
                        marks.append(m)
            k += 1
        if not last:
            return none
        last, marks = np.array(last), np.array(marks)
        width = np.array(self.automaton.widths)[marks]
        true = self._spelled(words, number, last, width)
        return last[true], width[true], marks[true]

    def _spelled(self, words: Words, number: np.ndarray, last: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Whether the words of each occurrence are those of the items, by their bytes and not their hashes alone."""
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(covered, last - width + 1, 1)
        np.add.at(covered, last + 1, -1)
        wrong = np.zeros(len(words) + 1, dtype=np.int64)
        for p in np.flatnonzero(np.cumsum(covered[:-1])).tolist():
            wrong[p + 1] = words.word(p) != self.spelling[number[p]]
        np.cumsum(wrong, out=wrong)
        return wrong[last + 1] == wrong[last - width + 1]

    def judge(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, hit word spans [a, b) merged, and the items that occur (all as strings)."""
        return self._judge(Words(texts, ALNUM), len(texts))

    def _judge(self, words: Words, n: int) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        last, width, mark = self.occurrences(words)
        row = words.row[last] if len(last) else last
        order = np.lexsort((last - width, row))
        last, width, mark, row = last[order], width[order], mark[order], row[order]
        cuts = np.searchsorted(row, np.arange(n + 1))
        for r in range(n):
            spans: list[list[int]] = []
            items: set[int] = set()
            for i in range(cuts[r], cuts[r + 1]):
                a, b = int(last[i] - width[i] + 1 - words.first[r]), int(last[i] + 1 - words.first[r])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
                items.update(self.automaton.owners[mark[i]])
            yield int(words.first[r + 1] - words.first[r]), [(a, b) for a, b in spans], [self.automaton.ids[i] for i in items]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_shards(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items (item_id, text) in shards of about ``shard_bytes``; one shard is on the driver at a time."""
    usable = items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("string"), "text")
    total = usable.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    n = int(total // shard_bytes) + 1
    for k in range(n):
        part = usable.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else usable
        yield sorted((r[0], r[1]) for r in part.collect())


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, names: tuple[str, str, str] = NAMES
) -> DataFrame:
    """The columns of docs (with text), and n_words, spans (array of word ranges from, to), items (array of item ids as strings), as ``names`` has them."""
    kinds = (F.lit(0).cast("long"), F.array().cast("array<struct<from:int,to:int>>"), F.array().cast("array<string>"))
    out = docs.withColumns(dict(zip(names, kinds, strict=True)))
    schema, first = out.schema, True
    for shard in item_shards(items, shard_bytes):
        index = share(docs.sparkSession, Index(shard, window))

        def walk(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("text")
                for a, b in slices(batch.column(at)):
                    part = batch.slice(a, b - a)
                    old_spans, old_items = part.column(names[1]).to_pylist(), part.column(names[2]).to_pylist()
                    counts, spans, found = [], [], []
                    for r, (n, s, i) in enumerate(index.value.judge(part.column(at))):
                        counts.append(n)
                        s = _merge(s + [(x["from"], x["to"]) for x in old_spans[r]]) if old_spans[r] else s
                        spans.append([{"from": x, "to": y} for x, y in s])
                        found.append(sorted({*i, *old_items[r]}))
                    for name, values in zip(names, (counts, spans, found), strict=True):
                        k = part.schema.get_field_index(name)
                        part = part.set_column(k, part.schema.field(k), pa.array(values, part.schema.field(k).type))
                    yield part

        out = map_in_arrow(out if first else store(out), walk, schema)
        first = False
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, coverage: float = 0.5, span_words: int = 13
) -> DataFrame:
    """Documents without contaminated spans.

    A document in which ``min_items`` items occur, or of whose words ``coverage`` or more
    are hit, goes. From others, hit spans of at least ``span_words`` words are cut out of
    the text. The columns of docs come back, and n_removed (words cut).
    """
    docs = docs.drop("n_removed")
    counted, ranges, found = free_names([*docs.columns, "n_removed"], *NAMES)
    judged = contamination(docs, items, window, names=(counted, ranges, found))
    hit = F.aggregate(ranges, F.lit(0), lambda s, x: s + x["to"] - x["from"])
    kept = judged.filter((F.size(found) < min_items) & (hit < F.greatest(F.lit(1), F.col(counted)) * coverage))
    names = docs.columns
    schema = kept.select(*names, F.lit(0).alias("n_removed")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text"), batch.column(ranges)
            removed = np.zeros(len(texts), dtype=np.int32)
            changed = {}
            for r, own in enumerate(spans.to_pylist()):
                own = [(x["from"], x["to"]) for x in own if x["to"] - x["from"] >= span_words]
                if own:
                    words = Words(texts.slice(r, 1), ALNUM)
                    raw, out, at = texts[r].as_py().encode(), b"", 0
                    for a, b in own:
                        out, at = out + raw[at : words.start[a]], int(words.end[b - 1])
                        removed[r] += b - a
                    changed[r] = (out + raw[at:]).decode("utf-8", "replace")
            if changed:
                values = texts.to_pylist()
                for r, t in changed.items():
                    values[r] = t
                texts = pa.array(values, texts.type)
            columns = [texts if c == "text" else batch.column(c) for c in names] + [pa.array(removed)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_removed"])

    return map_in_arrow(kept, cut, schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return judged.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= MIN_ITEMS).alias("contaminated"),
    )


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[a:a + least(8, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS a FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, k, a, array_to_string(w[a:a + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM words, widths WHERE len(w) >= k)),
found AS (SELECT g.doc_id, g.a, g.k, x.item_id FROM grams g JOIN windows x ON g.k = x.k AND g.win = x.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM found) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items,
       sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(o.n, 0) >= 2 AS contaminated
FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id LEFT JOIN own o ON w.doc_id = o.doc_id
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same result by comparing all windows; for tests."""
    import re

    fold = {c: c + 32 for c in range(65, 91)}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        w = cut(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if own := windows.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= MIN_ITEMS))
    return out
