"""Vectorised words and word-window hashes over Arrow string columns.

A batch's UTF-8 bytes are looked at as one NumPy array, so no Python loop runs
per short word. A word of up to ``LONG`` bytes is hashed in blocks of eight bytes, each block mixed in
by a bijection; a longer one by BLAKE2b. (A polynomial over bytes modulo 2**64 would not do: Thue-Morse words
collide under every base.) A window's hash is a polynomial over word hashes, so windows of any width cost
the same; two windows of up to 20 words that differ agree with a probability below 2**-50.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 18

U64 = np.uint64
_WORD_BASE = 0xD1342543DE82EF95
#: Bytes up to which a word is hashed block by block.
LONG = 32


class _Powers:
    """Growing tables of an odd base's powers and inverse powers modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = self._table(self.base, size), self._table(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out, done = np.ones(size, U64), 1
        while done < size:
            out[done : 2 * done] = out[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        return out


_word_powers = _Powers(_WORD_BASE)

#: Separators: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Separators: every ASCII character but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BLOCK_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans of ``data``, A-Z counted as a-z."""
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=padded[: len(data)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - start
    h = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(size <= LONG)
    for block in range(0, LONG, 8):
        if block:
            at = at[size[at] > block]
        if not len(at):
            break
        x = eight[start[at] + block] & _BLOCK_MASKS[np.minimum(size[at] - block, 8)]
        h[at] = mix(h[at] ^ x)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """Words of some consecutive texts: byte spans in ``data``, text number and hash of each."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # word number at which each text begins, and the total at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` words and the word number of each, no window crossing texts.
        Another ``salt`` gives an independent hash."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, U64), np.empty(0, np.int64)
        up, down = _word_powers.get(len(self.hash))
        sums = np.zeros(len(self.hash) + 1, U64)
        np.cumsum((mix(self.hash ^ U64(salt)) if salt else self.hash) * up, out=sums[1:])
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix((sums[at + k] - sums[at]) * down[at] + U64(k)), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text the hashes of its ``k``-word windows, sorted and distinct; texts of fewer words
        have their whole sequence as one. Returns hashes and where each text's begin (and the end)."""
        h, at = self.windows(k)
        count = self.counts
        short = np.flatnonzero((count > 0) & (count < k))
        doc = self.doc[at]
        if len(short):
            up, down = _word_powers.get(len(self.hash))
            sums = np.zeros(len(self.hash) + 1, U64)
            np.cumsum(self.hash * up, out=sums[1:])
            a, b = self.first[short], self.first[short + 1]
            whole = mix((sums[b] - sums[a]) * down[a] + count[short].astype(U64))
            h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(count) + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> Words:
    """Words between separators, A-Z counted as a-z."""
    n = len(data)
    inside = ~separators[data]
    left = np.zeros(n + 1, bool)
    left[1:] = inside
    bounds = offsets[(offsets >= 0) & (offsets < n)]
    left_of = left[:n].copy()
    left_of[bounds] = False
    right_of = np.zeros(n, bool)
    right_of[: max(n - 1, 0)] = inside[1:]
    right_of[bounds[bounds > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~left_of), np.flatnonzero(inside & ~right_of) + 1
    h = word_hashes(data, start, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return Words(data, offsets, start, end, doc, h, first)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column of about ``limit`` bytes: first row, end row, bytes, offsets."""
    bounds = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        yield a, b, *texts(column.slice(a, b - a))  # copies so many rows only, whatever the batch's size
        a = b


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte (and in all)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of flat values and bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
