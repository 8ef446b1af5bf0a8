"""Whole-text primitives over Arrow string columns, vectorised with numpy.

A *word* is a maximal run of bytes other than space and \\x09-\\x0D after
lower-casing A-Z only.  Nulls count as empty texts.  All hashes are 64-bit;
equality of hashes stands for equality of words throughout the subpackage
(collision odds at 1e12 distinct items are about 1e-7 per compared pair).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RELEASE_EVERY = 4 << 20  # bytes of text
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK8 = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_C1, _C2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def word_spans(low: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the row pointer by text; ``space`` marks the bytes between words."""
    n = int(offs[-1])
    gap = space[low[:n]]
    solid = np.ones(n + 1, dtype=bool)
    solid[:n] = gap
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.ones(n, dtype=bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:n]))
    ends = np.flatnonzero(~gap & (solid[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, with eight zero bytes of padding behind."""
    out = np.zeros(len(raw) + 8, np.uint8)
    np.take(LOWER, raw, out=out[: len(raw)])
    return out


def hash_spans(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``padded`` has eight bytes behind the last span."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    load = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    h = size.astype(np.uint64) * _K
    h = mix(h ^ (load[starts] & _MASK8[np.minimum(size, 8)]))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest):
        left = size[rest] - at
        h[rest] = mix(h[rest] * _K ^ (load[starts[rest] + at] & _MASK8[np.minimum(left, 8)]))
        at += 8
        rest = rest[left > 8]
    return h


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded lower-cased bytes, starts, ends, row pointer, word hashes)."""
    raw, offs = text_bytes(col)
    low = lowered(raw)
    s, e, ptr = word_spans(low, offs)
    return low, s, e, ptr, hash_spans(low, s, e)


def shingles(h: np.ndarray, ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and their row pointer.

    A text with 1 to ``width - 1`` words has its whole sequence as one shingle;
    one without words has none.
    """
    n_words = np.diff(ptr)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    out_ptr = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n_words)), count)
    at = np.arange(out_ptr[-1]) - out_ptr[:-1][doc] + ptr[:-1][doc]
    reach = np.minimum(n_words, width)[doc]
    out = reach.astype(np.uint64) * _K
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for k in range(width):
        nxt = padded[at + k]
        nxt = np.where(k < reach, nxt, np.uint64(0))
        out = mix(out * _K + nxt)
    return out, out_ptr


def release_memory() -> None:
    """Gives freed memory back to the system, so that workers which live on stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of text (one row at least)."""
    passed = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        at = b.schema.get_field_index(column)
        _, offs = text_bytes(b.column(at))
        first = 0
        while first < b.num_rows:
            last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
            last = min(max(last, first + 1), b.num_rows)
            yield b.slice(first, last - first)
            passed += int(offs[last] - offs[first])
            if passed > RELEASE_EVERY:
                release_memory()
                passed = 0
            first = last
    release_memory()


def crc_fold(ids: np.ndarray, modulus: int) -> np.ndarray:
    """crc32 of each id written as text, modulo ``modulus``."""
    import zlib

    return np.fromiter((zlib.crc32(str(i).encode()) % modulus for i in ids.tolist()), np.int64, len(ids))
