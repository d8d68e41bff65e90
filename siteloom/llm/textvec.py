"""Vectorised primitives over the UTF-8 buffer of an Arrow string column.

A block is a run of at most ``most`` whole rows of ``limit`` bytes together (or one longer row); all arrays below are over
one block, so memory is bounded by the block and the longest single text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_QI = np.uint64(pow(int(_Q), -1, 1 << 64))


def give_back() -> None:
    """Return what a task has freed to the system: a worker that waits for its next task holds its memory otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 12), base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 1 << 21:
            _POWERS[int(base)] = have
    return have[:n]


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19, most: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each block; null texts are empty."""
    col = pc.cast(pc.fill_null(batch.column(batch.schema.names.index(column)), ""), pa.large_string())
    n = len(col)
    if not n:
        return
    buffers = col.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + most)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] |= word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cuts - 1] |= word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_P, len(buf)), out=total[1:])
    inverse = powers(_PI, len(buf) + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _Q)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive elements; element i is that of h[i:i+k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=total[1:])
    return mix((total[k:] - total[:n]) * powers(_QI, n) + np.uint64(k))


def row_starts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's elements begin in an array sorted by row; n_rows + 1 entries."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each row after lower-casing A-Z: hashes ascending within rows, and rows.

    A row of fewer than k words has its whole sequence as one shingle; a row without words has none.
    """
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, ends, rows = word_spans(low, offs)
    words = span_hash(low, starts, ends)
    n_rows = len(offs) - 1
    at = row_starts(rows, n_rows)
    full = window_hash(words, k)
    ok = np.zeros(len(full), bool)
    if len(full):
        ok = rows[: len(full)] == rows[k - 1 :]
    h, r = full[ok], rows[: len(full)][ok]
    counts = np.diff(at)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([window_hash(words[at[i] : at[i + 1]], counts[i])[0] for i in short], np.uint64)
        h, r = np.concatenate([h, extra]), np.concatenate([r, short])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[keep], r[keep]
    return h, r


def fast_sketch(h: np.ndarray, rows: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """Fast similarity sketches of t coordinates for the sets of each row.

    Round i < t throws every element into one of the t bins by a hash of its own; round t + b gives every
    element to bin b, so each coordinate of a non-empty set fills. A bin keeps its least (round, hash), and a
    row leaves the rounds once its bins are full. Rows without elements keep the largest value throughout.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    S = np.full(n_rows * t, empty, np.uint64)
    live_h, live_r = np.asarray(h, np.uint64), np.asarray(rows)
    low = np.uint64(0xFFFFFFFF)
    for i in range(t):
        if not len(live_h):
            break
        x = mix(live_h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(S, live_r * t + bins.astype(np.int64), (np.uint64(i) << np.uint64(32)) | (x & low))
        if i % 4 == 0 or i < 12:
            open_rows = (S.reshape(n_rows, t) == empty).any(axis=1)
            keep = open_rows[live_r]
            live_h, live_r = live_h[keep], live_r[keep]
    if len(live_h):
        lo = 0
        while lo < len(live_h):
            r = live_r[lo]
            hi = int(np.searchsorted(live_r, r, side="right"))
            own = S[r * t : (r + 1) * t]
            gaps = np.flatnonzero(own == empty)
            if len(gaps):
                seeds = (gaps.astype(np.uint64) + np.uint64(t + 1)) * _P
                x = mix(live_h[lo:hi, None] + seeds[None, :]) & low
                own[gaps] = ((gaps.astype(np.uint64) + np.uint64(t)) << np.uint64(32)) | x.min(axis=0)
            lo = hi
    return S.reshape(n_rows, t)
