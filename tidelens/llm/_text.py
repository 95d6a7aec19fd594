"""Vectorised text helpers: numpy over the Arrow buffers that Spark hands to a task.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Nothing here holds more than one
slice of a batch, so memory is bounded by ``SLICE_BYTES`` or by the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 6_000_000
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Odd multipliers of the word and window hashes.
_BASE = 0x9E3779B97F4A7C15
_WINDOW = 0xD6E8FEB86659FD93
#: Bytes from which on a span is hashed all at once.
_LONG = 64
#: The low 0 to 8 bytes of a word of the machine.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Give freed memory back to the system: Spark keeps Python workers, and each would hold its largest task's."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each slice come to about ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    inside = ~SEPARATOR[buf]
    if not inside.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, eight bytes at a time; of long spans all eights at once."""
    lengths = ends - starts
    h = lengths.astype(np.uint64)
    if not len(starts):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), np.uint64, padded, 0, (1,))  # the eight bytes from every place on
    long = np.flatnonzero(lengths > _LONG)
    if len(long):
        h[long] = _long_hashes(eights, starts[long], lengths[long])
    live = slice(None) if not len(long) else np.flatnonzero(lengths <= _LONG)
    at, left = starts[live], lengths[live]
    while len(at):
        part = eights[at] & _MASKS[np.minimum(left, 8)]
        h[live] = (h[live] ^ mix(part + np.uint64(_BASE))) * np.uint64(_BASE)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(h)


def _long_hashes(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the mixed eights of each span, each with a factor for its place."""
    n = -(-lengths // 8)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    part = eights[np.repeat(starts, n) + 8 * place] & _MASKS[np.minimum(np.repeat(lengths, n) - 8 * place, 8)]
    factor = mix(place.astype(np.uint64) + np.uint64(_WINDOW)) | np.uint64(1)
    return np.add.reduceat(mix(part + np.uint64(_BASE)) * factor, first) + mix(lengths.astype(np.uint64))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` values, in order (len - size + 1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(_WINDOW)
    for k in range(size):
        out *= factor
        out += words[k : k + n]
    return mix(out + np.uint64(size))


def code_points(buf: np.ndarray) -> np.ndarray:
    """For each byte, whether it begins a code point."""
    return (buf & 0xC0) != 0x80
