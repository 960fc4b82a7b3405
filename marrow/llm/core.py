"""Vectorised word scanning shared by the operators that run in Arrow batches.

A batch's texts are one UTF-8 byte buffer with offsets.  Words, lines and
their 64-bit hashes come from a handful of numpy passes over the buffer, so no
Python object is made per word.  Work goes chunk by chunk (about
``CHUNK_BYTES`` of text, or one longer document), which bounds memory by the
longest single document, not by the batch.

Word hashes are polynomial sums modulo 2**64 over a fixed random table of
byte values, finished with an avalanche mix; they are equal in every task and
every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

try:  # glibc
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None

CHUNK_BYTES = 1 << 20

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche mix (finaliser of the public-domain SplitMix64 generator)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


BASE = U64(0x8A5CD789635D2DFF)
#: inverse of BASE modulo 2**64
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept up to one chunk, longer ones are made anew."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, CHUNK_BYTES)
    made = []
    for base in (BASE, BASE_INV):
        p = np.full(size, base, U64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= 4 * CHUNK_BYTES:
        _POWERS[:] = made
    return made[0], made[1]


class Scanner:
    """Splits byte buffers into words of the bytes for which ``word_byte`` is true."""

    def __init__(self, word_byte: np.ndarray, lower: bool = False):
        table = _byte_table()
        if lower:
            table[65:91] = table[97:123]
        self.word_byte = word_byte
        self.table = np.where(word_byte, table, U64(0))

    def __call__(self, buf: np.ndarray, offsets: np.ndarray, hashed: bool = True
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes, first): byte spans and hashes of all words of a
        chunk; the words of document d are those from first[d] to first[d + 1]."""
        n = len(buf)
        inside = self.word_byte[buf]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        first = np.searchsorted(starts, offsets)
        if not hashed:
            return starts, ends, np.empty(0, U64), first
        if not len(starts):
            return starts, ends, np.empty(0, U64), first
        up, down = _powers(n)
        h = np.add.reduceat(self.table[buf] * up[:n], starts) * down[starts]
        return starts, ends, mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)), first


def _set(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: words ``[^\x20\x09-\x0D]+``
SPACE_BYTE = _set([0x20, *range(0x09, 0x0E)])
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased
ALNUM_BYTE = _set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: lines between newlines
LINE_BYTE = ~_set([0x0A])
#: bytes that begin a code point
LEAD_BYTE = ~_set(range(0x80, 0xC0))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one row."""
    if not len(column):
        return
    buf, offsets = buffers(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def rolling(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any window of words follows; one longer than ``hashes``."""
    up, _ = _powers(len(hashes) + 1)
    return np.concatenate((np.zeros(1, U64), np.cumsum(hashes * up[: len(hashes)], dtype=U64)))


def window_hashes(prefix: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all windows of m words, by their first word; equal words hash alike anywhere."""
    count = len(prefix) - m
    if count <= 0:
        return np.zeros(0, U64)
    _, down = _powers(len(prefix))
    return mix64((prefix[m:] - prefix[:-m]) * down[:count] + U64(m))


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d + 1]]; empty segments give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """The document of every item, from the documents' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct_pairs(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted by owner, then value; owner is ascending."""
    if not len(value):
        return owner, value
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    keep = np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])))
    return o[keep], v[keep]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def over_batches(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """``mapInArrow`` function that applies ``fn`` to every batch."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return run


def give_back() -> None:
    """Return the freed memory of this worker to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
