"""Vectorised words and word n-grams of Arrow string columns.

Texts are handled as one byte array per slice of rows. A word's hash is a sum over its runs of eight bytes, each
mixed with a key of its place, so that cost is a few array passes per word and no Python object is made per word.
An n-gram's hash combines those of its halves, which overlapping n-grams share. Both steps are non-linear: no
family of strings collides by construction, as repetitive ones do in polynomials modulo 2**64. n-grams can be
hashed with several seeds where 64 bits aren't enough to tell them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that are handled at once, and words whose hashes are made at once.
SLICE_BYTES = 1 << 20
WORDS_AT_ONCE = 1 << 18
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def place_keys(n: int) -> np.ndarray:
    """Of the first n runs of eight bytes."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


KEYS = place_keys(LONG_WORD // 8)
#: Masks of the first 0 to 8 bytes of a run.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)

#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)

#: Bytes of words: all but space and \t to \r ...
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ... or, after lower-casing, digits, a-z and whatever isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (len + 1) and bytes of a string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, raw


@dataclass
class Words:
    """Words of rows ``first`` .. ``first + rows - 1`` of a batch; ``rows`` at most as many as fit a slice."""

    first: int
    rows: int
    padded: np.ndarray  # bytes of the rows, folded, and eight more
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # of each word, from 0
    counts: np.ndarray  # words of each row
    begins: np.ndarray  # of each row's first word; rows + 1 entries

    @property
    def data(self) -> np.ndarray:
        return self.padded[:-8]

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        for a in range(0, len(out), WORDS_AT_ONCE):
            out[a : a + WORDS_AT_ONCE] = self._hashes(self.starts[a : a + WORDS_AT_ONCE], self.ends[a : a + WORDS_AT_ONCE])
        return out

    def _hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        runs = np.ndarray((len(self.padded) - 7,), "<u8", self.padded, strides=(1,))
        size = ends - starts
        out = mix((runs[starts] & MASKS[np.minimum(size, 8)]) ^ KEYS[0])
        left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        for k in range(1, len(KEYS)):
            if not len(left):
                break
            out[left] += mix((runs[starts[left] + 8 * k] & MASKS[np.minimum(size[left] - 8 * k, 8)]) ^ KEYS[k])
            left = left[size[left] > 8 * (k + 1)]
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            mine = runs[int(starts[w]) : int(ends[w]) : 8].copy()
            mine[-1] &= MASKS[(int(size[w]) - 1) % 8 + 1]
            out[w] = mix(mine ^ place_keys(len(mine))).sum(dtype=U64)
        return mix(out + size.astype(U64))

    def text(self, a: int, b: int) -> bytes:
        """Words a .. b - 1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b]))


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two hashes, in their order."""
    x = a * U64(0x9FB21C651E98DF25)
    x += b * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xE7037ED1A0B428DB)
    x ^= x >> U64(29)
    return x


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each position on; positions whose n words don't end in time are dropped."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    power = mix(hashes + U64(seed)) if seed else hashes
    out, at, size = None, 0, 1
    while True:
        if n & size:
            part = power[at : at + m]
            out = part if out is None else combined(out, part)
            at += size
        if size * 2 > n:
            return mix(out + U64(n))
        power = combined(power[:-size], power[size:])
        size *= 2


def within(words: Words, n: int) -> np.ndarray:
    """For each position of ``grams(.., n)``: do its n words lie in one row?"""
    m = len(words.row) - n + 1
    return words.row[:m] == words.row[n - 1 :] if m > 0 else np.zeros(0, bool)


def slices(column: pa.Array, fold: np.ndarray, table: np.ndarray, most: int = SLICE_BYTES) -> Iterator[Words]:
    """Whole rows in slices of about ``most`` bytes; a longer row is a slice of its own."""
    off, raw = string_buffers(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n)
        # one separator byte after each row, so that no word crosses rows
        lengths = np.diff(off[a : b + 1])
        ends = np.cumsum(lengths + 1) - 1
        padded = np.full(int(lengths.sum()) + (b - a) + 8, 0x20, np.uint8)
        data = padded[:-8]
        keep = np.ones(len(data), bool)
        keep[ends] = False
        data[keep] = fold[raw[off[a] : off[b]]]
        inside = table[data]
        inside[ends] = False
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(ends, starts, "left")
        counts = np.bincount(row, minlength=b - a)
        yield Words(a, b - a, padded, starts, stops, row, counts, np.concatenate([[0], np.cumsum(counts)]))
        a = b
