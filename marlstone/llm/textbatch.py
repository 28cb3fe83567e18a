"""Words of a whole Arrow batch at once: offsets and 64-bit hashes as NumPy arrays.

A word is a maximal run of bytes whose table entry is true. Separators are ASCII in every table
here, so a run of UTF-8 bytes is a run of code points too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_BYTE = np.arange(256)
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~np.isin(_BYTE, list(SPACES))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
#: A-Z to a-z, other bytes as they are
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: 1 where a code point starts
STARTS = ((_BYTE & 0xC0) != 0x80).astype(np.uint8)

_LIBC = ctypes.CDLL(None)
_RANDOM = np.random.default_rng(20240501)
_BYTE_KEY = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, mod 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _STEP)]), dtype=np.uint64)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i] .. starts[i]+lengths[i]-1 for each i."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


@dataclass
class Words:
    """Words of a batch. doc is the row of each word, first the number of words before each row."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len+1 byte bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are ascending, not empty, and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    at = ranges(start, lengths)
    within = at - np.repeat(start, lengths)
    terms = _BYTE_KEY[data[at]]
    terms *= powers(int(lengths.max()))[within]
    heads = np.cumsum(lengths) - lengths
    return mix(np.add.reduceat(terms, heads))


def words(column: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False, hashed: bool = True) -> Words:
    """Words of every row of a string column."""
    data, bounds = raw(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    step = np.diff(inside)
    edge = bounds[1:-1]  # a row's end also ends a word
    edge = edge[(edge > 0) & (edge < len(data))]
    cut = edge[(inside[edge] == 1) & (inside[edge + 1] == 1)]
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cut):
        cut = np.unique(cut)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    first = np.searchsorted(start, bounds).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, start, end, doc, first, hash_spans(data, start, end) if hashed else np.zeros(0, np.uint64))


def windows(w: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one row: (first word's index, row, hash)."""
    n = w.counts()
    runs = np.maximum(n - size + 1, 0)
    at = ranges(w.first[:-1], runs)
    h = np.full(len(at), np.uint64(salt) * _STEP + np.uint64(size))
    for k in range(size):
        h = (h ^ w.hash[at + k]) * _STEP
        h ^= h >> np.uint64(29)
    return at, np.repeat(np.arange(len(n)), runs), mix(h)


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices values[first[i]:first[i+1]]; empty slices give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside the JVM of their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch of about `most` text bytes each; a longer text makes one of its own."""
    if not batch.num_rows:
        return
    _, bounds = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()
