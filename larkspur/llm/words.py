"""Vectorised word, shingle and window hashing over Arrow string columns.

A word is a maximal run of bytes outside space and 0x09-0x0D.  Hashing works on
the UTF-8 buffer of a whole record batch, eight bytes of every word at a time: each
step mixes the next eight bytes into the state by a bijection that is not linear,
so words of up to eight bytes never collide, and no family of words is known to
collide whatever the constants (as Thue-Morse words do for polynomials modulo a
power of two).  Very long words are hashed by BLAKE2.  Two independent lanes make
a 128-bit key.  No per-word Python objects are made for words of usual length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first n bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Words of more bytes are hashed one by one.
_LONG = 64
#: (length, state, step) constants of each lane.
_LANES = ((0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0x5851F42D4C957F2D, 0xA3B195354A39B70D))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return bytes_buffer(column.fill_null("") if column.null_count else column)


def bytes_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls and len+1 offsets into them."""
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes; a longer text comes alone."""
    data, offsets = text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of some texts: first bytes, lengths, and len+1 word positions `first` at which the texts begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        word = ~_SPACE[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = word[edges]
        edges = edges[edges > 0] - 1
        ends[edges] = word[edges]
        self.starts = np.flatnonzero(begins)
        self.lengths = np.flatnonzero(ends) + 1 - self.starts
        self.first = np.searchsorted(self.starts, offsets)
        self.data = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
        self._eights = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def part(self, at: np.ndarray | slice, skip: int = 0) -> np.ndarray:
        """Bytes skip to skip + 8 of the words `at`, as numbers; missing bytes are 0."""
        return self._eights[self.starts[at] + skip] & _FIRST[np.minimum(self.lengths[at] - skip, 8)]

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A hash of each word; those of the two lanes are independent."""
        length, state, step = (U64(c) for c in _LANES[lane])
        out = mix(self.part(slice(None)) + self.lengths.astype(U64) * length ^ state)
        skip, at = 8, np.flatnonzero(self.lengths > 8)
        while len(at) and skip < _LONG:
            out[at] = mix(out[at] ^ self.part(at, skip)) * step
            skip += 8
            at = at[self.lengths[at] > skip]
        for i in at.tolist():
            word = self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()
            out[i] = np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), U64)[lane]
        return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their first bytes, and len+1 word positions at which the texts begin."""
    words = Words(data, offsets, lower)
    return words.hashes(), words.starts, words.first


def runs_of(words: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """An unmixed hash of every k consecutive entries, by doubling; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    part, width, total, at, scale = words, 1, None, 0, 1
    while True:
        if k & width:
            piece = part[at : at + n] * U64(scale)
            total = piece if total is None else total + piece
            at += width
            scale = scale * pow(multiplier, width, 1 << 64) % (1 << 64)
        if width * 2 > k:
            return total
        part = part[:-width] + part[width:] * U64(pow(multiplier, width, 1 << 64))
        width *= 2


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles and len+1 positions; a text with 1 to k-1 words gives one shingle of all its words."""
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    pos = np.r_[0, np.cumsum(made)]
    out = np.empty(pos[-1], U64)
    long = np.flatnonzero(counts >= k)
    if len(long):
        every = runs_of(words, k, 0xD1342543DE82EF95)
        keep = np.ones(len(every) + 1, np.int32)
        # a start is kept unless fewer than k words of its text follow
        index = np.arange(len(every))
        owner_end = np.repeat(first[1:], counts)[: len(every)]
        keep = index + k <= owner_end
        target = np.ones(pos[-1], bool)
        short = np.flatnonzero((counts > 0) & (counts < k))
        target[pos[short]] = False
        out[target] = mix(every[keep])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = U64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[first[i] : first[i + 1]]:
                h = h * U64(0xA0761D6478BD642F) + w
        out[pos[i]] = mix(np.array([h ^ U64(0x5851F42D4C957F2D)]))[0]
    return out, pos
