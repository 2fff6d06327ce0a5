"""Whole Arrow batches of text as numpy arrays: blocks of documents, words, lines and hashes of spans.

Everything works on the UTF-8 bytes of many documents at once, so that no Python code runs for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer document is a block of its own.
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_STEP))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK + 1024)
        for name, base in (("_powers", _BASE), ("_inverses", _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] a hash of codes[i:j], up to the power that `span_hash` takes out."""
    _grow(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the codes from each start up to its end, the same wherever those codes stand."""
    raw = (prefix[end] - prefix[start]) * _inverses[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(_STEP))


def gram_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """`span_hash` of every n codes in a row."""
    count = max(0, len(prefix) - n)
    raw = (prefix[n:] - prefix[:count]) * _inverses[:count]
    return mix(raw + np.uint64((n * _STEP) % (1 << 64)))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about `limit` bytes."""
    data, offsets = text_arrays(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; no run crosses an offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each document the place of its first word."""
    start, end = runs(~SPACE[data], offsets)
    return start, end, np.searchsorted(start, offsets, "left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(BYTE_CODE[data]), start, end)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element the index i with bounds[i] <= element < bounds[i + 1]."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    total = int(length.sum())
    first = np.cumsum(length) - length
    return np.arange(total) - np.repeat(first - start, length)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the place of one example of each, and for each key its number."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.ones(len(keys), bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(begins) - 1
    return ordered[begins], order[begins], inverse


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in some [s, s + length)."""
    if not len(starts):
        return np.zeros(n, bool)
    delta = np.bincount(starts, minlength=n + length + 1) - np.bincount(starts + length, minlength=n + length + 1)[: n + length + 1]
    return np.cumsum(delta)[:n] > 0


class SpanCache:
    """Integer sequences of spans seen before, found by the spans' hashes in an open-addressing table; emptied when it would
    hold more than `limit`. Hashes alone tell spans apart: with 2**21 spans held, a new one is taken for another with odds of 1e-13."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self._table(1 << 16)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.flat, self.used, self.held = np.zeros(1 << 16, np.int32), 0, 0

    def _table(self, slots: int) -> None:
        self.shift = np.uint64(65 - slots.bit_length())
        self.keys = np.zeros(slots, np.uint64)
        self.entry = np.full(slots, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot = (keys >> self.shift).view(np.int64)
        found = self.entry[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (found >= 0))
        found[other] = -1
        slot = slot[other]
        while len(other):
            slot = (slot + 1) & (len(self.keys) - 1)
            entry = self.entry[slot]
            same = self.keys[slot] == keys[other]
            found[other[same]] = entry[same]  # an empty slot's key, 0, may be asked for: its entry is -1
            on = ~same & (entry >= 0)
            other, slot = other[on], slot[on]
        return found

    def _insert(self, keys: np.ndarray, entry: np.ndarray) -> None:
        slot = (keys >> self.shift).view(np.int64)
        while len(keys):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entry[free]  # of several keys for one slot the last stays
            won = free & (self.entry[slot] == entry)
            self.keys[slot[won]] = keys[won]
            keys, entry, slot = keys[~won], entry[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of the distinct keys that `add` has to bring before `get` can be asked for all of them."""
        new = np.flatnonzero(self.find(keys) < 0)
        new = new[distinct(keys[new])[1]]
        if self.held + len(new) > self.limit and self.held:
            self.reset()
            return distinct(keys)[1]
        return new

    def add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        while len(self.flat) < self.used + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        n = self.held + len(keys)
        while len(self.at) < n:
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        self.at[self.held : n] = self.used + np.cumsum(size) - size
        self.size[self.held : n] = size
        entry = np.arange(self.held, n, dtype=np.int32)
        self.held, self.used = n, self.used + len(flat)
        if 2 * n > len(self.keys):
            full = np.flatnonzero(self.entry >= 0)
            old_keys, old_entry, slots = self.keys[full], self.entry[full], len(self.keys)
            while 2 * n > slots:
                slots *= 2
            self._table(slots)
            self._insert(old_keys, old_entry)
        self._insert(keys, entry)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of the keys one after another, and the length of each."""
        entry = self.find(keys)
        size = self.size[entry].astype(np.int64)
        return self.flat[ragged(self.at[entry], size)], size
