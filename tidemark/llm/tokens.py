"""Texts as units that are encoded once: pieces of text between borders that no token crosses.

A border stands before a space that follows a character other than white space. Byte-level vocabularies that split text
before a space, and pieces that hold the mark of a space at their start alone, never cross it. Characters of a block that
also holds white space (such as dashes and curly quotes) count as white space here, which only makes units longer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True
MOST_KNOWN, MOST_IDS = 600_000, 6_000_000


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every segment, one segment after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Where each segment starts, and the end of the last."""
    return np.append(0, np.cumsum(lengths))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each starts (one more at the end); a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    begins = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[begins[0] : begins[-1]], begins - begins[0]


def strings(data: np.ndarray, begins: np.ndarray) -> pa.LargeBinaryArray:
    """The byte strings that data holds between borders (as many as there are borders, less one)."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(np.ascontiguousarray(begins, np.int64)), pa.py_buffer(data)])


def units(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Borders of the units of all texts, with the end of the last; begins: where texts start, and the end."""
    at = np.flatnonzero(data == 32)
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    white = WHITE[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    for lead, second in ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)):
        white |= (three == lead) & (two == second)
    return np.unique(np.concatenate([at[~white], begins, [0, len(data)]]))


class Known:
    """The ids of distinct byte strings, encoded when they first come; emptied when it holds too many."""

    def __init__(self, encode: Callable[[pa.LargeBinaryArray], tuple[np.ndarray, np.ndarray]], kind: str = "<u4"):
        self.encode, self.kind = encode, kind
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.length, self.flat = np.empty(0, np.int64), np.empty(0, self.kind)

    def ids(self, values: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all values, one value after the other, and how many each has."""
        if len(self.known) > MOST_KNOWN or len(self.flat) > MOST_IDS or self.known.nbytes > 16 * MOST_KNOWN:
            self._clear()
        coded = values.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            own = coded.dictionary.take(pa.array(new))
            flat, lengths = self.encode(own)
            place[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, own])
            self.length, self.flat = np.append(self.length, lengths), np.append(self.flat, flat.astype(self.kind))
        place = place[coded.indices.to_numpy()]
        lengths = self.length[place]
        return self.flat[ragged((offsets(self.length)[:-1])[place], lengths)], lengths
