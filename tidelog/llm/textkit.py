"""Words of Arrow string columns as NumPy arrays, found on the UTF-8 bytes without Python strings.

All offsets are byte offsets into one buffer that holds the texts of a batch one
after the other. A batch is handled in slices of about ``SLICE_BYTES``, so that the
temporary arrays stay bounded; one longer text makes a slice of its own and is still
handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: True for the bytes of a word `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: True for the bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Words of more bytes than this are hashed by BLAKE2b, the others by eight bytes at a time.
LONG_WORD = 64

#: Masks that keep the first n bytes of eight, for n from 0 to 8.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (a finaliser of two rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts joined, and n + 1 offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: ``start``, ``end`` in ``raw`` (lower-cased), ``row`` of each, and ``first``, n + 1 word offsets by row."""

    def __init__(self, texts: pa.Array, keep: np.ndarray) -> None:
        raw, self.offsets = utf8(texts)
        size, n = len(raw), len(self.offsets) - 1
        self._eights = np.zeros(size // 8 + 2, dtype="<u8")  # the bytes, and some behind them, eight by eight
        self.raw = self._eights.view(np.uint8)[:size]
        np.take(_LOWER, raw, out=self.raw)
        inside = keep[self.raw]
        begins, cuts = inside.copy(), np.zeros(size + 1, dtype=bool)
        cuts[self.offsets] = True
        if size:
            begins[1:] &= ~inside[:-1] | cuts[1:-1]
        ends = inside.copy()
        if size:
            ends[:-1] &= ~inside[1:] | cuts[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def eight(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The first ``count`` (8 at most) of the eight bytes at each place, as numbers, zeros behind them."""
        low, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        out = self._eights[low] >> shift
        out |= (self._eights[low + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        out &= _FIRST[np.minimum(count, 8)]
        return out

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word.

        Eight bytes at a time go through a bijection of the hash so far, so that words of
        one length and at most eight bytes never share a hash.
        """
        size = self.end - self.start
        with np.errstate(over="ignore"):
            out = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
            live, done = np.flatnonzero(size <= LONG_WORD), 0
            while len(live):
                left = size[live] - done
                out[live] = mix(out[live] ^ self.eight(self.start[live] + done, left))
                live, done = live[left > 8], done + 8
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            word = self.raw[self.start[k] : self.end[k]]
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        return out

    def word(self, k: int) -> bytes:
        return self.raw[self.start[k] : self.end[k]].tobytes()


def word_hash(word: bytes, seed: int = 0) -> int:
    """The same hash for one word."""
    return int(Words(pa.array([word.decode()]), np.ones(256, dtype=bool)).hashes(seed)[0])


def shingles(words: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash.

    A text of fewer words has its whole sequence as one; without words it has none.
    """
    h, first = words.hashes(seed), words.first
    counts = np.diff(first)
    n = len(h)
    with np.errstate(over="ignore"):
        if n >= width:
            full = np.zeros(n - width + 1, dtype=np.uint64)
            for i in range(width):
                full = full * np.uint64(0xFF51AFD7ED558CCD) + h[i : n - width + 1 + i]
            inside = words.row[: n - width + 1] == words.row[width - 1 :]
            rows, values = words.row[: n - width + 1][inside], mix(full[inside])
        else:
            rows, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            own = np.zeros(len(short), dtype=np.uint64)
            for i in range(width - 1):
                has = counts[short] > i
                at = np.minimum(first[short] + i, n - 1)
                own = np.where(has, own * np.uint64(0xFF51AFD7ED558CCD) + h[at], own)
            own = mix(own + counts[short].astype(np.uint64))
            rows, values = np.concatenate([rows, short]), np.concatenate([values, own])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]
