"""Piece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

The vocabulary is read from a tokenizer file, whose path is a parameter; nothing is
trained. A unigram file gives its log scores as they are. A file whose scores are whole
numbers, the ranks of merges, gives no probabilities; its pieces, in that order, get the
log scores of Zipf's law, -ln((rank + 1) * H) with H the harmonic number of all pieces. A
text gets a leading whitespace marker and a marker for every space; the segmentation
with the largest sum of scores is taken, ties going to the longer last piece. A
character for which there is no piece costs ``UNKNOWN_PENALTY`` less than the worst
piece, and is given by its UTF-8 bytes. Decoding joins the pieces, bytes among them,
turns markers into spaces and drops the leading one, so that ``decode(encode(text))``
is the text again for every text.

No piece holds a marker behind another character, so that every segmentation has a
boundary there. A text is cut at those places; Arrow finds the distinct chunks of a
slice, each of which is segmented once, all short ones together as NumPy arrays. With a
vocabulary that has such pieces, whole texts are segmented.

Scale: a narrow stage; workers hold the trie (a few MB, checked by the size of the
vocabulary) and at most ``CACHE`` chunks of up to ``SHORT`` characters. ``round_trip``
encodes and decodes in one worker.

Defined cases: null stays null (null ids, n_tokens 0); an empty text has no pieces; a
marker character in the text itself is given by its bytes, so that it comes back; a
text without spaces is one chunk of any length; repeated rows are alike; ids that are
not in the vocabulary are an error in decoding, bytes that are no UTF-8 become U+FFFD;
an empty table gives no rows; other columns pass through, those that ``encode`` and
``decode`` set are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.runtime import map_in_arrow, share, table
from tidelog.llm.textkit import slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MARK = MARK.encode()
UNKNOWN_PENALTY = 10.0
CACHE = 100_000
SHORT = 32
MAX_PIECES = 2_000_000


def read_pieces(path: str = MODEL) -> tuple[list[tuple[int, str, float]], dict[int, int]]:
    """(id, piece, score) of the ordinary pieces, and the ids of the byte pieces by byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, by_byte = [], {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            by_byte[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((i, model.id_to_piece(i), model.get_score(i)))
    if pieces and all(s <= 0 and s == int(s) for _, _, s in pieces):  # ranks of merges, no probabilities
        order = {i: r for r, (i, _, _) in enumerate(sorted(pieces, key=lambda x: (-x[2], x[0])))}
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        pieces = [(i, p, -math.log(order[i] + 1) - total) for i, p, _ in pieces]
    return pieces, by_byte


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is t = base[s] + c if check[t] == s."""

    def __init__(self, keys: Iterable[tuple[list[int], int]]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for codes, v in keys:
            s = 0
            for c in codes:
                if (t := children[s].get(c)) is None:
                    t = children[s][c] = len(children)
                    children.append({})
                    value.append(-1)
                s = t
            value[s] = v
        top = max((c for x in children for c in x), default=0) + 2
        size = 4 * len(children) + 2 * top
        base, check, own = (np.full(size, x, dtype=np.int64) for x in (0, -1, -1))
        check[0], own[0] = 0, value[0]  # the root; no child is placed here
        place, free = {0: 0}, 1
        waiting = [(-len(children[0]), 0)] if children[0] else []
        while waiting:  # the largest families first, each once its parent has a place
            _, s = heapq.heappop(waiting)
            codes = np.array(sorted(children[s]))
            if len(codes) == 1:
                while free < size and check[free] != -1:
                    free += 1
                if free < size:
                    (c, child), = children[s].items()
                    base[place[s]], check[free], own[free] = free - c, place[s], value[child]
                    place[child] = free
                    if children[child]:
                        heapq.heappush(waiting, (-len(children[child]), child))
                    continue
            while free < size - 1 and check[free] != -1:
                free += 1
            at = free - int(codes[0])
            while True:
                fits = np.arange(at, at + 512)
                for c in codes:
                    while len(fits) and fits[-1] + c >= size:
                        base, check, own = (np.concatenate([x, np.full(size, y)]) for x, y in ((base, 0), (check, -1), (own, -1)))
                        size *= 2
                    fits = fits[check[fits + c] == -1]
                if len(fits):
                    break
                at += 512
            at = int(fits[0])
            base[place[s]] = at
            for c in codes.tolist():
                child = children[s][c]
                check[at + c] = place[s]
                place[child], own[at + c] = at + c, value[child]
                if children[child]:
                    heapq.heappush(waiting, (-len(children[child]), child))
        used = int(np.flatnonzero(check != -1)[-1]) + top + 1
        pad = max(0, used - size)
        self.base, self.check, self.value = (
            np.concatenate([x, np.full(pad, y)])[:used] for x, y in ((base, 0), (check, -1), (own, -1))
        )


class Encoder:
    def __init__(self, pieces: list[tuple[int, str, float]], by_byte: dict[int, int]) -> None:
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"{len(pieces)} pieces; workers are meant to hold at most {MAX_PIECES}")
        self.by_byte = by_byte
        chars = sorted({ord(c) for _, p, _ in pieces for c in p.replace(MARK, " ")})
        self.codes = np.zeros(0x110000, dtype=np.int32)  # by character, a space being the marker; 0: in no piece
        self.codes[chars] = np.arange(1, len(chars) + 1)
        self.trie = DoubleArray((self._codes(p.replace(MARK, " ")).tolist(), k) for k, (_, p, _) in enumerate(pieces))
        self.ids = np.array([i for i, _, _ in pieces], dtype=np.int32)
        self.scores = np.array([s for _, _, s in pieces], dtype=np.float64)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY if len(pieces) else -1.0
        self.longest = max((len(p) for _, p, _ in pieces), default=1)
        self.cuttable = not any(MARK in p.lstrip(MARK) for _, p, _ in pieces)
        self.cache: dict[bytes, bytes] = {}  # chunks and their ids, four bytes each
        bytes_of: list[bytes | None] = [None] * (max([i for i, _, _ in pieces] + [*by_byte.values()], default=-1) + 1)
        for i, p, _ in pieces:
            bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in by_byte.items():
            bytes_of[i] = bytes([b])
        self.bytes_of = pa.array(bytes_of, pa.large_binary())

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """What is segmented on its own, as bytes with spaces for markers, and n + 1 chunk offsets by text."""
        raw, offsets = utf8(texts)
        some = np.diff(offsets) > 0
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])  # each text gets a space in front
        front = np.zeros(int(offsets[-1]), dtype=bool)
        front[offsets[:-1][some]] = True
        data = np.full(len(front), 0x20, dtype=np.uint8)
        data[~front] = raw
        begins = front
        if self.cuttable:
            space = data == 0x20
            begins[1:] |= space[1:] & ~space[:-1]
        marks = np.flatnonzero((data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2]))
        begins[marks] = True
        begins[(marks + 3)[marks + 3 < len(data)]] = True
        starts = np.flatnonzero(begins)
        own = np.append(starts, len(data)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(own), pa.py_buffer(data)]), np.searchsorted(starts, offsets)

    def _codes(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]

    def _fallback(self, char: str) -> list[int]:
        return [self.by_byte[b] for b in char.encode("utf-8", "replace")]

    def _path(self, chunk: str, start: list[int], piece: list[int]) -> bytes:
        """Ids along the best path; start and piece hold, by end, the last piece (-1: by bytes)."""
        out, at = [], len(chunk)
        while at:
            k = piece[at]
            out.append([self.ids[k]] if k >= 0 else self._fallback(chunk[at - 1]))
            at = start[at]
        return np.array(list(chain.from_iterable(reversed(out))), dtype=np.int32).tobytes()

    def segment(self, chunk: str) -> bytes:
        """The ids of the best segmentation of one chunk of any length."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(chunk)
        codes = self._codes(chunk).tolist()
        best, start, piece = [0.0] + [-np.inf] * n, [-1] * (n + 1), [-1] * (n + 1)
        for s in range(n):
            state, single = 0, False
            for e in range(s, n):
                if not codes[e]:
                    break
                t = int(base[state]) + codes[e]
                if check[t] != state or t == 0:
                    break
                state = t
                if (k := int(value[t])) >= 0:
                    single |= e == s
                    if (x := best[s] + float(scores[k])) > best[e + 1]:
                        best[e + 1], start[e + 1], piece[e + 1] = x, s, k
            if not single and (x := best[s] + self.unknown) > best[s + 1]:
                best[s + 1], start[s + 1], piece[s + 1] = x, s, -1
        return self._path(chunk, start, piece)

    def segment_all(self, chunks: list[str]) -> list[bytes]:
        """``segment`` of many short chunks, position by position for all at once."""
        m, width = len(chunks), max(map(len, chunks))
        lengths = np.array([len(c) for c in chunks])
        flat = self._codes("".join(chunks))
        codes = np.zeros((width + 1, m), dtype=np.int64)
        column = np.repeat(np.arange(m), lengths)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes[row, column] = flat
        best = np.full((width + 1, m), -np.inf)
        best[0] = 0
        start, piece = np.full((width + 1, m), -1), np.full((width + 1, m), -1)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(width):
            live = np.flatnonzero(lengths > s)
            state, single = np.zeros(len(live), dtype=np.int64), np.zeros(m, dtype=bool)
            alive = live
            for e in range(s, min(width, s + self.longest)):
                code = codes[e, alive]
                t = base[state] + code
                goes = (code > 0) & (check[t] == state) & (t > 0)
                alive, state = alive[goes], t[goes]
                if not len(alive):
                    break
                k = value[state]
                has = k >= 0
                who, k = alive[has], k[has]
                if e == s:
                    single[who] = True
                x = best[s, who] + self.scores[k]
                better = x > best[e + 1, who]
                who, k, x = who[better], k[better], x[better]
                best[e + 1, who], start[e + 1, who], piece[e + 1, who] = x, s, k
            who = live[~single[live]]
            x = best[s, who] + self.unknown
            better = x > best[s + 1, who]
            who = who[better]
            best[s + 1, who], start[s + 1, who], piece[s + 1, who] = x[better], s, -1
        # back along all best paths at once; -2 fills the columns of shorter paths
        steps, at, who = [], lengths.copy(), np.arange(m)
        odd = np.zeros(m, dtype=bool)
        while len(who):
            k = piece[at[who], who]
            odd[who[k < 0]] = True
            step = np.full(m, -2)
            step[who] = k
            steps.append(step)
            at[who] = start[at[who], who]
            who = who[at[who] > 0]
        paths = np.stack(steps[::-1], axis=1)
        used = paths > -2
        flat, ends = self.ids[np.maximum(paths[used], 0)].tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._path(chunks[i], start[:, i].tolist(), piece[:, i].tolist())
        return out

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All ids one after the other, and n + 1 offsets by text."""
        chunks, first = self.chunks(texts)
        distinct = chunks.dictionary_encode()
        values = distinct.dictionary.to_pylist()
        found = [self.cache.get(c) for c in values]
        missing = [k for k, f in enumerate(found) if f is None]
        names = [values[k].decode("utf-8", "replace") for k in missing]
        short = [i for i, n in enumerate(names) if len(n) <= SHORT and values[missing[i]] != _MARK]
        for a in range(0, len(short), 8192):
            part = short[a : a + 8192]
            for i, ids in zip(part, self.segment_all([names[i] for i in part]), strict=True):
                found[missing[i]] = ids
        if len(self.cache) + len(short) > CACHE:
            self.cache.clear()
        self.cache.update((values[missing[i]], found[missing[i]]) for i in short[:CACHE])
        for k, name in zip(missing, names, strict=True):
            if found[k] is None:
                found[k] = np.array(self._fallback(MARK), dtype=np.int32).tobytes() if values[k] == _MARK else self.segment(name)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
        which = distinct.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        return lists.take(distinct.indices).flatten(), ends[first]

    def decode(self, ids: pa.Array, offsets: np.ndarray, mask: pa.Array | None = None) -> pa.Array:
        """The text of each range of ids; null where ``mask`` is true."""
        found = self.bytes_of.take(ids)
        if found.null_count:
            raise ValueError("an id that the vocabulary does not have")
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[: len(found) + 1]  # the pieces stand one after the other
        data = found.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[: ends[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        cuts = ends[offsets]
        fronts = cuts[:-1][np.diff(cuts) > 0]
        keep = np.ones(len(raw), dtype=bool)
        keep[fronts[raw[fronts] == 0x20]] = False
        cuts = np.concatenate([[0], np.cumsum(keep)])[cuts]
        texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw[keep])])
        try:
            texts = texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())
        return (texts if mask is None else pc.if_else(mask, None, texts)).cast(pa.string())


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    for name, values in columns.items():
        k = batch.schema.get_field_index(name)
        batch = batch.set_column(k, batch.schema.field(k), values.cast(batch.schema.field(k).type))
    return batch


@lru_cache(maxsize=2)
def load(model: str) -> Encoder:
    return Encoder(*read_pieces(model))


def round_trip(docs: DataFrame, model: str = MODEL, to: str | None = "decoded") -> DataFrame:
    """The columns of docs (with text), ids (array<int>), n_tokens, and in column ``to`` the text that the ids stand for."""
    new = {"ids": F.lit(None).cast("array<int>"), "n_tokens": F.lit(0).cast("long")}
    out = docs.withColumns(new if to in (None, "text") else new | {to: F.lit(None).cast("string")})
    shared = share(docs.sparkSession, load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                null = part.column("text").is_null()
                ids, offsets = encoder.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids, mask=null)
                columns = {"ids": lists, "n_tokens": pa.array(np.diff(offsets))}
                yield _with(part, columns if to is None else columns | {to: encoder.decode(ids, offsets, null)})
        encoder.cache.clear()

    return map_in_arrow(out, run, out.schema)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of docs (with text), and ids (array<int>), n_tokens."""
    return round_trip(docs, model, to=None)


def decode(encoded: DataFrame, model: str = MODEL, to: str = "decoded") -> DataFrame:
    """The columns of encoded (with ids), and the text that the ids stand for."""
    out = encoded.withColumn(to, F.lit(None).cast("string"))
    shared = share(encoded.sparkSession, load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            yield _with(batch, {to: shared.value.decode(lists.flatten(), offsets, lists.is_null())})

    return map_in_arrow(out, run, out.schema)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, a digest of the ids, and whether decoding them gives the text back."""
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
