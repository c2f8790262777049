"""Texts as runs of chunks, so that a tokenizer works once on each different chunk.

The callers choose boundaries that no token of their vocabulary crosses; then the tokens of a text are those of
its chunks, one after another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class ChunkCache:
    """Chunk -> number of an entry. Filled first come, first kept up to `most`; frequent chunks come early, and the rest is worked out again each time."""

    def __init__(self, encode: Callable[[list[bytes]], list], most: int):
        self.encode, self.most, self.at, self.entries = encode, most, {}, []

    def entries_of(self, chunks: list[bytes]) -> list:
        """The entry of each chunk; chunks must differ."""
        at, entries = self.at, self.entries
        found = [at.get(c) for c in chunks]
        missing = [c for c, k in zip(chunks, found) if k is None]
        new = iter(self.encode(missing) if missing else [])
        out = []
        for c, k in zip(chunks, found):
            if k is None:
                entry = next(new)
                if len(entries) < self.most:
                    at[c] = len(entries)
                    entries.append(entry)
            else:
                entry = entries[k]
            out.append(entry)
        return out


class FlatCache:
    """ChunkCache for lists of integers, in flat arrays: no Python object for each known chunk."""

    def __init__(self, encode: Callable[[pa.BinaryArray], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most  # encode gives the sizes of the lists, and the lists one after another
        self.known, self.sizes, self.values = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lists_of(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, values) of the list of each chunk; chunks must differ."""
        at, absent = places(chunks, self.known)
        sizes, values = self.sizes, self.values
        if absent.any():
            new = chunks.filter(pa.array(absent))
            new_sizes, new_values = self.encode(new)
            at[absent] = len(sizes) + np.arange(len(new))
            sizes, values = np.concatenate([sizes, new_sizes]), np.concatenate([values, new_values])
            if len(sizes) <= self.most:
                self.known, self.sizes, self.values = pa.concat_arrays([self.known, new]), sizes, values
        return (np.cumsum(sizes) - sizes)[at], sizes[at], values


class RowCache:
    """ChunkCache for rows of numbers, in flat arrays."""

    def __init__(self, encode: Callable[[list[bytes]], np.ndarray], most: int, width: int):
        self.encode, self.most, self.known, self.rows = encode, most, pa.array([], pa.binary()), np.zeros((0, width))

    def rows_of(self, chunks: pa.BinaryArray) -> np.ndarray:
        """The row of each chunk; chunks must differ."""
        at, absent = places(chunks, self.known)
        if not absent.any():
            return self.rows[at]
        new = chunks.filter(pa.array(absent))
        rows = np.concatenate([self.rows, self.encode(new.to_pylist())])
        at[absent] = len(self.rows) + np.arange(len(new))
        if len(rows) <= self.most:
            self.known, self.rows = pa.concat_arrays([self.known, new]), rows
        return rows[at]


def places(chunks: pa.BinaryArray, known: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each chunk in known, whether it isn't there)."""
    found = pc.index_in(chunks, value_set=known)
    return pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64), found.is_null().to_numpy(zero_copy_only=False)


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, pa.BinaryArray]:
    """(number of each chunk, the different chunks). Chunks start at `starts` and reach to `ends`, or to the next start."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    if ends is None:
        offsets = np.append(starts, len(data)).astype(np.int32)
    else:  # drops what lies between
        keep = np.zeros(len(data) + 1, np.int8)
        keep[starts] += 1
        keep[ends] -= 1
        data = data[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]
        offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    column = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """coded(), with the chunks as a list."""
    codes, chunks = coded(data, starts, ends)
    return codes, chunks.to_pylist()


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of `sizes` values from `starts`, one after another, and where each of those begins, with the end."""
    ends = np.append(0, np.cumsum(sizes))
    return values[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)], ends
