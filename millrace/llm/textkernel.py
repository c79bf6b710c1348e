"""Vectorised word and window hashing over Arrow string columns.

Texts are read where Arrow keeps them (one byte buffer and its offsets), so no Python string is made per word. Words are the maximal
runs of bytes outside ``\\x20\\x09-\\x0D``; those separators are ASCII, so working on UTF-8 bytes gives the same words as working on
code points.

Hashes are 64 bits wide. A span is taken eight bytes at a time through a bijective mixer, spans above LONG bytes through BLAKE2; windows
are folded from halves through the same mixer. Nothing is linear in the input, so no family of texts collides by construction: two
different spans agree with a probability of about 2**-64. Where that is not enough, callers take a second hash under another seed.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SIZE = U64(0xA24BAED4963EE407)
_LEFT = U64(0xD1B54A32D192ED03)
#: Spans above so many bytes are hashed one by one.
LONG = 512
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
CHUNK_BYTES = 1 << 18
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def release() -> None:
    """Gives free memory back: Python workers are kept for later tasks, and what they hold counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_calls = 0


def release_sometimes(every: int = 64) -> None:
    """``release`` at every so many calls, for functions that are called once a group."""
    global _calls
    _calls += 1
    if _calls % every == 0:
        release()


def released(run: Callable) -> Callable:
    """A function for mapInArrow that calls ``release`` when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values spread over all 64 bits."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``most`` bytes each; a longer row is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words of rows a..b: where each starts and ends in ``data``, and how many each row has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        space = SPACE[data]
        first = np.ones(n, bool)
        first[1:] = space[:-1]
        last = np.ones(n, bool)
        last[:-1] = space[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[edges] = True
        last[edges - 1] = True
        word = ~space
        self.start, self.end = np.flatnonzero(first & word), np.flatnonzero(last & word) + 1
        self.at = np.searchsorted(self.start, offsets)  # row r has words at[r]..at[r + 1]
        self.count = np.diff(self.at)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        return span_hashes(LOWER[self.data] if lower else self.data, self.start, self.end, seed)

    def windows(self, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row's windows of ``width`` words, the index of the first word, and the window's hash."""
        first = ragged(self.at[:-1], np.maximum(self.count - width + 1, 0))
        return first, joined(h, width)[first] if len(first) else np.zeros(0, U64)


def fold(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    return mix(left * _LEFT + right)


def joined(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` hashes in a row, from hashes of 1, 2, 4, ... of them."""
    out, used, power, span = None, 0, h, 1
    while True:
        if width & span:
            part = power[used : used + len(h) - width + 1]
            out = mix(part + U64(width)) if out is None else fold(out, part)
            used += span
        span *= 2
        if span > width:
            return out
        power = fold(power[: -(span // 2)], power[span // 2 :])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same from starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each byte span."""
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(U64) * _SIZE + U64(seed))
    short = size <= LONG
    live = np.arange(len(size)) if short.all() else np.flatnonzero(short)
    at, left, own = start[live], size[live], h[live]
    while len(live):
        own = mix(own ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        h[live] = own
        live, at, left, own = live[more], at[more] + 8, left[more] - 8, own[more]
    for k in np.flatnonzero(~short).tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[k] = int.from_bytes(digest, "little")
    return h


def each_chunk(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of rows."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets, most):
        at = offsets[a : b + 1]
        yield a, b, Words(data[at[0] : at[-1]], at - at[0])


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each row."""
    out = np.zeros(len(column), np.int64)
    for a, b, words in each_chunk(column):
        out[a:b] = words.count
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    return sums_by_row((data & 0xC0) != 0x80, offsets)


def sums_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
