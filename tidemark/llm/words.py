"""Words of texts as 64-bit hashes, worked out for whole Arrow batches at once.

A word is a run of characters other than space and \\t \\n \\v \\f \\r. Hashes do not depend on the task or machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SLICE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i up to n."""
    size = 1 << max(n, 2**16).bit_length()
    if size not in _powers:
        _powers.clear()
        both = []
        for b in (BASE, INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers[size] = tuple(both)
    return _powers[size]


def _hash_slice(data: np.ndarray, begins: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word in data; no word crosses one of the positions in begins."""
    n = len(data)
    gap = SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[begins] = edge[n] = True
    edge[1:] |= np.append(gap[1:], True)
    after = edge[:n].copy()  # a word may start here
    after[0] = True
    after[1:] |= gap[:-1]
    starts = np.flatnonzero(~gap & after)
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[LOWER[data] if fold else data] * power[:n], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def hashed(column: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of documents: first and last + 1 index, hashes of all their words, and where each document's words start.

    Long texts are cut at a separator into slices, so the scratch memory stays small; the words of a document are together.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        parts, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], begin
        while at < end:
            stop = min(end, at + SLICE)
            while stop < end and not SEPARATOR[data[at:stop]].any():
                stop = min(end, stop + SLICE)
            if stop < end:
                stop = at + int(np.flatnonzero(SEPARATOR[data[at:stop]])[-1]) + 1
            inside = offsets[first:last]
            begins = inside[(inside >= at) & (inside < stop)] - at
            h, s, _ = _hash_slice(data[at:stop], begins, fold)
            parts.append(h)
            starts.append(s + at)
            at = stop
        where = np.concatenate(starts)
        yield first, last, np.concatenate(parts), np.searchsorted(where, offsets[first : last + 1])
        first = last


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of the batch whose texts in a column take about `most` bytes together; a longer text comes alone."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    # what the last slices left goes back to the machine, which other workers share
    pa.default_memory_pool().release_unused()
