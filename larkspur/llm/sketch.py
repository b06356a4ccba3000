"""A count-min sketch that tells single keys from repeated ones, built in tasks and merged in blocks.

Counters stop at 2.  A task sends the counters that its keys touch, sorted and
packed as gaps; merged counters never fall below a key's count, so a key whose
smallest counter is 1 occurs once, and a repeated key is never taken for single.
With `least` 1 the same bits are a Bloom filter: no key is ever taken for absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import tidy
from .words import U64, mix

ROWS = 2
#: Counters of a row: at most 2**28, so that the merged bits (32 MB a row) can be broadcast whatever the data.
MIN_BITS, MAX_BITS = 20, 28
_BLOCK_BITS = 18
#: Keys that a task gathers before it emits counters; bounds its memory.
STRETCH = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA3B195354A39B70D, 0xC2B2AE3D27D4EB4F)


def bits_for(keys: int, room: int = 2) -> int:
    """Counters for `room` times the keys, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, int(room * keys).bit_length()))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * U64(_ODD[row])) >> U64(64 - bits)).astype(np.int64)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Strictly increasing numbers as gaps: a byte each, 255 standing for 255 more to come."""
    if not len(numbers):
        return b""
    gaps = np.diff(numbers, prepend=-1) - 1
    at = np.cumsum(gaps // 255 + 1) - 1
    out = np.full(at[-1] + 1, 255, np.uint8)
    out[at] = gaps % 255
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 255)
    return np.cumsum(raw, dtype=np.int64)[ends] + np.arange(len(ends))


def _counters(keys: np.ndarray, bits: int, depth: int) -> pa.RecordBatch:
    width = 1 << min(bits, _BLOCK_BITS)
    rows, blocks, once, more = [], [], [], []
    edges = np.arange(0, (1 << bits) + 1, width)
    for row in range(depth):
        own = np.sort(cells(keys, row, bits))
        new = np.r_[True, own[1:] != own[:-1]]
        unique = own[new]
        twice = unique[np.diff(np.r_[np.flatnonzero(new), len(own)]) > 1]
        a, b = np.searchsorted(unique, edges), np.searchsorted(twice, edges)
        for block in np.flatnonzero(np.diff(a)).tolist():
            rows.append(row)
            blocks.append(block)
            once.append(pack_sorted(unique[a[block] : a[block + 1]] - block * width))
            more.append(pack_sorted(twice[b[block] : b[block + 1]] - block * width))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["cell_row", "block", "once", "more"])


def repeated_cells(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, depth: int = ROWS, least: int = 2) -> np.ndarray:
    """`depth` arrays of packed bits: may the counter be `least` (1 or 2) or more?  keys_of gives the keys of a batch of df, in parts."""
    width = 1 << min(bits, _BLOCK_BITS)

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= STRETCH:
                    yield _counters(np.concatenate(held), bits, depth)
                    held, n = [], 0
        if n:
            yield _counters(np.concatenate(held), bits, depth)

    def merge(batches):
        seen: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row, block, once, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                held = seen.setdefault((row, block), np.zeros(width, np.uint8))
                at = unpack_sorted(once.as_py())
                held[at] = np.minimum(held[at] + 1, 2)
                held[unpack_sorted(more.as_py())] = 2
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array([np.packbits(v >= least).tobytes() for v in seen.values()], pa.binary())], ["cell_row", "block", "bits"])

    parts = 1 << max(0, min(8, bits - _BLOCK_BITS))
    counters = df.mapInArrow(tidy(count), "cell_row int, block int, once binary, more binary")
    merged = counters.repartition(parts, "cell_row", "block").mapInArrow(tidy(merge), "cell_row int, block int, bits binary")
    out = np.zeros((depth, (1 << bits) // width, width // 8), np.uint8)
    for r in merged.collect():  # of bounded size; a job for each partition would take longer
        out[r["cell_row"], r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(depth, -1)


def may_repeat(often: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """False only for keys that occur once."""
    keep = np.ones(len(keys), bool)
    for row in range(len(often)):
        c = cells(keys, row, bits)
        keep &= (often[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return keep


def number_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The keys of a batch whose one column holds whole numbers; null counts as 0."""
    yield mix(np.asarray(batch.column(0).fill_null(0)).astype(np.int64).view(U64))


def members(numbers: DataFrame, room: int = 8) -> tuple[np.ndarray, int]:
    """A Bloom filter of a column of whole numbers, and its bits for may_repeat; of bounded size, so it may let others pass."""
    bits = bits_for(numbers.count(), room)
    return repeated_cells(numbers, number_keys, bits, least=1), bits
