"""Vectorised text kernels used inside Arrow tasks.

A *block* is the bytes of a few whole documents laid end to end: ``buf`` (uint8) and
``offsets`` (one more than there are documents). Words are maximal runs of bytes other
than ``\\x09-\\x0D`` and space, which in UTF-8 is the code-point class
``[^\\x20\\x09-\\x0D]``. A null text is an empty document.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLOCK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        if size > 4 * BLOCK_BYTES:  # a huge document: don't keep its tables
            return both[0], both[1]
        have = _POWERS[0] = (both[0], both[1])
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for all spans at once, from one prefix sum."""
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_CODES[buf], starts, ends)


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``buf`` and ``offsets`` of a string or binary column; nulls become empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each document (one more entry than documents)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``size`` bytes of text, or one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        share = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``mapInArrow`` function ``run``, which gives what it has freed back to the system at its end: a worker waits for other tasks with some 50 MB less."""

    @functools.wraps(run)
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has and needs it
        if trim:
            trim(0)

    return through


def in_blocks(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", size: int = BLOCK_BYTES) -> Callable:
    """A ``mapInArrow`` function that applies ``f`` to slices of bounded size."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, size):
            out = f(part)
            if out is not None and out.num_rows:
                yield out

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start+1, …`` of all ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def squeeze(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with exactly one space after each: bytes, and new starts and ends."""
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1) - 1
    out = np.full(int(new_ends[-1]) + 1 if len(starts) else 0, 32, np.uint8)
    new_starts = new_ends - lengths
    out[ragged(new_starts, lengths)] = buf[ragged(starts, lengths)]
    return out, new_starts, new_ends


#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[start:end]`` for all spans at once."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    s = np.uint64(seed)
    at = starts.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        h = np.full(len(starts), s + P5, np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            acc = [np.full(len(long), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            stripes = size[long] // 32
            for k in range(int(stripes.max())):
                live = np.flatnonzero(stripes > k) if k else slice(None)
                p = at[long][live] + 32 * k
                for j in range(4):
                    acc[j][live] = _round(acc[j][live], eight[p + 8 * j])
            merged = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                merged = (merged ^ _round(np.zeros_like(a), a)) * P1 + P4
            h[long] = merged
            at[long] += 32 * stripes
        h += size.astype(np.uint64)
        rest = ends - at
        for k in range(3):
            live = np.flatnonzero(rest >= 8 * (k + 1))
            if len(live):
                h[live] = _rot(h[live] ^ _round(np.zeros(len(live), np.uint64), eight[at[live] + 8 * k]), 27) * P1 + P4
        at += rest // 8 * 8
        rest = ends - at
        live = np.flatnonzero(rest >= 4)
        h[live] = _rot(h[live] ^ (four[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        rest = ends - at
        for k in range(3):
            live = np.flatnonzero(rest > k)
            if len(live):
                h[live] = _rot(h[live] ^ (buf[at[live] + k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
