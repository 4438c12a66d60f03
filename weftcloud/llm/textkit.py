"""Vectorised text primitives over Arrow string columns: bytes, words, hashes of spans, ragged gathers.

A column of texts is one byte buffer with row offsets. Words are maximal runs of bytes of a class; since every
class here treats all bytes from 0x80 alike, runs of bytes are runs of code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = U64(0x9E3779B97F4A7C15)
_SEED = U64(0x5851F42D4C957F2D)
_KEY = b"weft spans"
_LONG = 256  # spans longer than this are hashed one by one
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside the given inclusive ranges."""
    out = np.ones(256, dtype=bool)
    for a, b in excluded:
        out[a : b + 1] = False
    return out


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: [^\x20\x09-\x0D]
NONSPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type) or len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def row_blocks(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_blocks(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) blocks of a column."""
    buf, off = column_bytes(col)
    for i, j in row_blocks(off, most):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets per row) of the runs of a byte class, never across rows."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    edge[off[:-1][off[:-1] < len(buf)]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1] = True
    np.logical_not(inside[1:], out=edge[:-1])
    edge[off[1:][off[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what a hashes followed by what b hashes; no algebra between them survives the mixing."""
    out = a * _ODD
    out ^= b
    out ^= out >> U64(29)
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(32)
    return out


def eights(buf: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as one number, zeros past the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal spans anywhere: eight bytes at a time, mixed after each; long spans by a keyed digest."""
    size = ends - starts
    out = mix(size.astype(U64) ^ _SEED)
    if not len(starts):
        return out
    words, at, row, left = eights(buf), starts, None, size
    while True:
        part = words[at] & _MASK[np.minimum(left, 8)]
        if row is None:
            out = joined_hash(out, part)
        else:
            out[row] = joined_hash(out[row], part)
        more = (left > 8) if row is not None else (size > 8) & (size <= _LONG)
        if not more.any():
            break
        row = np.flatnonzero(more) if row is None else row[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG):
        out[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return out


class Grams:
    """Hashes of all spans of a buffer from 8 bytes on: of each power of two by joining two halves, of others by joining two that overlap."""

    def __init__(self, buf: np.ndarray, longest: int):
        self.size = len(buf)
        self.level = {3: mix(eights(buf)[: max(len(buf) - 7, 0)] ^ _SEED)}
        k = 3
        while 2 << k <= longest:
            g, half = self.level[k], 1 << k
            self.level[k + 1] = joined_hash(g[: max(len(g) - half, 0)], g[half:])
            k += 1

    def every(self, width: int) -> np.ndarray:
        """The hash of the `width` bytes from each place on."""
        k = width.bit_length() - 1
        g, n = self.level[k], max(self.size - width + 1, 0)
        return joined_hash(g[:n], g[width - (1 << k) : width - (1 << k) + n])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = np.empty(len(starts), U64)
        power = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(power):
            r = power == k
            g = self.level[int(k)]
            out[r] = joined_hash(joined_hash(g[starts[r]], g[ends[r] - (1 << int(k))]), size[r].astype(U64))
        return out


def word_hashes(buf: np.ndarray, off: np.ndarray, table: np.ndarray):
    """(hashes of the words after lower-casing A-Z, word offsets per row, starts, ends)."""
    buf = LOWER[buf]
    s, e, wo = word_spans(buf, off, table)
    return span_hash(buf, s, e), wo, s, e


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start..start+length of every row, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]], 0 for an empty row."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def binary_rows(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows values[off[i]:off[i+1]] as a binary column."""
    data = np.ascontiguousarray(values).view(np.uint8)
    at = (np.asarray(off, np.int64) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: idle Python workers stay alive beside other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
