"""Words, lines and hashes of Arrow text columns, over whole batches in numpy.

A batch's texts are read as one buffer of UTF-8 bytes with offsets, so no Python strings are made. The hash of a byte
range is (H[end] - H[start]) * P^-start for prefix sums H of random byte values times P^i, all modulo 2^64, then mixed;
runs of words are hashed from word hashes in the same way.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another system's allocator
    _libc = None
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASES = [int(x) | 1 for x in _rng.integers(0, 2**64, 2, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 2**64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, inverse: int, n: int) -> np.ndarray:
        if len(self.tables[inverse]) < n:
            steps = np.full(max(n, 2 * len(self.tables[inverse])), self.bases[inverse], np.uint64)
            steps[0] = 1
            self.tables[inverse] = np.multiply.accumulate(steps)
        return self.tables[inverse][:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.get(0, len(values)), out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the ranges; equal contents have equal hashes wherever they stand."""
        return mix((prefix[ends] - prefix[starts]) * self.get(1, len(prefix))[starts])


BYTES, RUNS = Powers(BASES[0]), Powers(BASES[1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and n + 1 offsets; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns memory that is free to the system: workers share an executor's memory with its JVM and with one another."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `most` bytes of text (or one row): the rows, their bytes and offsets."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def pieces(is_gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of bytes that aren't gaps, cut at documents: starts, ends, and n + 1 offsets of documents into them."""
    inside = ~is_gap
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(inside)]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return BYTES.ranges(BYTES.prefix(BYTE_VALUE[data]), starts, ends)


def run_starts(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """Indexes of words at which a run of n words within one document starts."""
    total = int(word_offsets[-1])
    fits = np.zeros(total + 1, np.int64)
    counts = np.maximum(np.diff(word_offsets) - n + 1, 0)
    has = counts > 0
    np.add.at(fits, word_offsets[:-1][has], 1)
    np.add.at(fits, word_offsets[:-1][has] + counts[has], -1)
    return np.flatnonzero(np.cumsum(fits)[:total] > 0)


def run_hashes(prefix: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words, given RUNS.prefix(word hashes)."""
    return RUNS.ranges(prefix, starts, starts + n)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document of each entry that n + 1 offsets deal out."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each document's entries."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
