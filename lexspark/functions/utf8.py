"""Strings of an Arrow batch as bytes and offsets: cut, spelled and put together without a Python object per string."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLANK = 32


def bytes_of(strings: pa.Array) -> tuple:
    """(data, offsets) of strings or binaries; a missing one is empty."""
    if not (pa.types.is_string(strings.type) or pa.types.is_binary(strings.type)):
        strings = strings.cast(pa.string())
    if strings.null_count:
        strings = strings.fill_null("")
    if not len(strings):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends, np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0]:at[-1]], at - at[0]


def strings_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings that ``offsets`` cut ``data`` into."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def spelled(strings: pa.Array, n: int = 1) -> tuple:
    """(data, offsets, bytes of every unit) of strings with a blank between their units of ``n`` characters."""
    data, at = bytes_of(strings)
    first = (data & 0xC0) != 0x80  # of a character
    opens = np.zeros(len(data), bool)
    opens[at[:-1][at[:-1] < at[1:]]] = True
    if n > 1:
        nth = np.cumsum(first) - 1
        first &= (nth - np.repeat(nth[at[:-1][at[:-1] < at[1:]]], np.diff(at)[at[:-1] < at[1:]])) % n == 0
    blanks = np.append(0, np.cumsum(first & ~opens))
    out = np.full(len(data) + int(blanks[-1]), BLANK, np.uint8)
    out[np.arange(len(data)) + blanks[1:]] = data
    return out, at + blanks[at], np.diff(np.append(np.flatnonzero(first), len(data)))


class Pool:
    """Bytes that strings are put together from."""

    def __init__(self) -> None:
        self.held, self.size = [], 0

    def add(self, data) -> int:
        """Where ``data``, an array of bytes or a text, starts in the pool."""
        data = np.frombuffer(data.encode(), np.uint8) if isinstance(data, str) else data
        self.held.append(data)
        self.size += len(data)
        return self.size - len(data)

    def bytes(self) -> np.ndarray:
        self.held = [np.concatenate(self.held)]
        return self.held[0]


def glued(pool: np.ndarray, count: int, *pieces) -> tuple:
    """(data, offsets) of ``count`` strings, each made of ``pieces`` one behind the other; a piece: (starts in the pool, sizes)."""
    starts, sizes = (np.empty((count, len(pieces)), np.int64) for _ in range(2))
    for k, (start, size) in enumerate(pieces):
        starts[:, k], sizes[:, k] = start, size
    size = sizes.ravel()
    ends = np.cumsum(size)
    total = int(ends[-1]) if count else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((starts.ravel() - ends + size).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return pool[at], np.append(0, ends[len(pieces) - 1::len(pieces)])
