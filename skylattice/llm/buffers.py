"""Whole texts of an Arrow batch as flat numpy arrays, cut into chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary array; a null is an empty row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[texts.offset: texts.offset + len(texts) + 1]
    ends = ends.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]: ends[-1]], ends - ends[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES,
           most: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most ``most`` rows and ``limit`` bytes;
    a longer text is a run of its own."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + most, rows)
        yield (start, end, data[offsets[start]: offsets[end]],
               offsets[start: end + 1] - offsets[start])
        start = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte stays."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray,
          gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a longest run, within a row, of bytes that are no gap."""
    solid = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(gap[data], out=solid[:-1])
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= solid[heads]
    starts = np.flatnonzero(first)
    stop = np.zeros(len(data) + 1, dtype=bool)
    stop[1:] = solid[:-1] & ~solid[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]]
    stop[tails] |= solid[tails - 1]
    ends = np.flatnonzero(stop)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64; those of a chunk are kept, a longer text's are not."""
    known = _POWERS.get(base, np.zeros(0, np.uint64))
    if n > len(known):
        known = np.full(max(n, CHUNK_BYTES), np.uint64(base), dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= CHUNK_BYTES:
            _POWERS[base] = known
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word by prefix sums of a polynomial; depends on its bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = int(_BASE)
    power = _powers(len(data), base)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    undo = _powers(len(data), inverse)
    return mixed((total[ends] - total[starts]) * undo[starts])
