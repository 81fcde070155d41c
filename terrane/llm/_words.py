"""Vectorised word splitting of Arrow string columns.

All word rules of this subpackage are byte rules on UTF-8: every byte of a
multi-byte character is 0x80 or above and is always part of a word, so a table
of 256 booleans decides. Texts are handled whole, a slice of rows at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash



def _c_library() -> ctypes.CDLL | None:
    """The C library, told to return arrays of 4 MB and more to the system once they are freed; else it comes to keep ever larger ones for later."""
    try:
        library = ctypes.CDLL("libc.so.6")
        library.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        library.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
        return library
    except (OSError, AttributeError):  # another C library
        return None


_LIBRARY = _c_library()


def trim() -> None:
    """Return free memory to the system: other workers of the executor share it."""
    pa.default_memory_pool().release_unused()
    if _LIBRARY is not None:
        _LIBRARY.malloc_trim(0)


#: Bytes of text handled at once; a single longer text forms its own slice.
SLICE_BYTES = 4 << 20


def _table(breaks: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[breaks] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large_string without nulls (null: empty)."""
    column = batch.column(name).cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each starts (one more at the end)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each that cover the column."""
    if not len(column):
        return
    _, offsets = raw(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high
        low = high
    trim()


#: Bytes of a word that are hashed without a call for each.
_LONG = 64


class Words:
    """The words of some texts.

    `first[d]:first[d + 1]` are the words of text d; `begin` and `end` are byte
    positions in `data` (all texts joined, lower-cased if asked for).
    """

    def __init__(self, column: pa.Array, table: np.ndarray = SPACED, lower: bool = False):
        self.data, self.offsets = raw(column)
        if lower:
            self.data = _LOWER[self.data]
        inside = table[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        self.begin = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.begin, self.offsets)
        self.count = np.diff(self.first)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.begin)

    def array(self) -> pa.Array:
        """Every word as an Arrow string."""
        ends = np.zeros(len(self) + 1, dtype=np.int64)
        np.cumsum(self.end - self.begin, out=ends[1:])
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(ends), pa.py_buffer(self.data[self._inside]))

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words by number."""
        found = self.array().dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False), found.dictionary

    def hashed(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        codes, distinct = self.coded()
        return hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)

    def fast_hashes(self) -> np.ndarray:
        """Another 64-bit hash for each word, of eight bytes at a time; words over `_LONG` bytes by xxh3."""
        size = self.end - self.begin
        out = mix(size.astype(np.uint64) + np.uint64(_BASE))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        for k in range(0, min(int(size.max(initial=0)), _LONG), 8):
            longer = np.flatnonzero(size > k)
            for low in range(0, len(longer), 1 << 16):
                some = longer[low : low + (1 << 16)]
                part = padded[(self.begin[some] + k)[:, None] + np.arange(8)].view("<u8").ravel()
                left = np.minimum(size[some] - k, 8).astype(np.uint64)
                part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
                out[some] = mix(out[some] ^ part)
        for k in np.flatnonzero(size > _LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.begin[k] : self.end[k]])
        return out

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, size: int) -> np.ndarray:
        """First words of the runs of `size` words that lie in one text."""
        free = np.maximum(self.count - size + 1, 0)
        return np.repeat(self.first[:-1], free) + ramp(free)


def hashes(distinct: pa.Array) -> np.ndarray:
    """xxh3 of each string."""
    get = xxhash.xxh3_64_intdigest
    return np.fromiter((get(x) for x in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of `size` words from each word on; the last size - 1 places hold no meaning."""
    part, have, total, done = words.astype(np.uint64), 1, None, 0
    while True:
        if size & have:
            if total is None:
                total, done = part.copy(), have
            else:
                shifted = np.zeros_like(part)
                shifted[: max(len(part) - done, 0)] = part[done:]
                total = total + shifted * np.uint64(pow(_BASE, done, 1 << 64))
                done += have
        if done == size:
            return mix(total)
        shifted = np.zeros_like(part)
        shifted[: max(len(part) - have, 0)] = part[have:]
        part = part + shifted * np.uint64(pow(_BASE, have, 1 << 64))
        have *= 2


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values in each range first[i]:first[i + 1]."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Which of n places lie in a run of `size` places from one of the starts on."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:n]) > 0


def grouped(keys: np.ndarray, codes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort runs of `size` words so that equal ones stand together.

    keys: a hash of each run; codes: exact numbers of all words; starts: each
    run's first word. Returns the order (stable) and whether each place of it
    begins a new run. Equal keys are confirmed word by word; if two different
    runs ever share a key, the numbers themselves are sorted instead.
    """
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    later = np.flatnonzero(~new)
    if len(later):
        heads = np.flatnonzero(new)
        own = starts[order[later]]
        first = starts[order[heads[np.searchsorted(heads, later) - 1]]]
        if not all(np.array_equal(codes[own + j], codes[first + j]) for j in range(size)):
            columns = [codes[starts + j] for j in range(size)][::-1]
            order = np.lexsort([*columns, keys])
            new[1:] = False
            for column in [*columns, keys]:
                ranked = column[order]
                new[1:] |= ranked[1:] != ranked[:-1]
    return order, new
