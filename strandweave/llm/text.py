"""Words and hashes of Arrow text columns with numpy, half a MB of bytes at a time.

Texts are taken as UTF-8 bytes. All separators used here are ASCII, so cutting at bytes is
cutting at code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

#: Space and \x09-\x0D separate words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = np.full(1 << 12, 0x9E3779B97F4A7C15, _U)
_BASE[0] = 1
_POWERS = np.multiply.accumulate(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, bytes, offsets) of up to ``most`` bytes; nulls are empty.

    A row longer than ``most`` makes a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; no run crosses a row's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < n)]
    start[borders] = inside[borders]
    end[borders - 1] = inside[borders - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    taken = data[np.repeat(starts, lengths) + within].astype(_U) + _U(1)
    return mix(np.add.reduceat(taken * _POWERS[within & (len(_POWERS) - 1)] * (_U(1) + (within >> 12).astype(_U) * _U(2)), first) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, how many spans start before its end: borders into the spans' arrays."""
    return np.searchsorted(starts, offsets, "left")


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], _U)


def shingles(words: np.ndarray, borders: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words of each row, repeats included, and their borders.

    A row with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(borders)
    n_of = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_borders = np.concatenate([[0], np.cumsum(n_of)])
    out = np.zeros(int(out_borders[-1]), _U)
    if not len(out):
        return out, out_borders
    step = mix(np.resize(_STEP, width) + np.arange(width, dtype=_U)) | _U(1)
    full = counts >= width
    if full.any():
        rolled = np.zeros(max(0, len(words) - width + 1), _U)
        for k in range(width):
            rolled += (words[k : k + len(rolled)] ^ (words[k : k + len(rolled)] >> _U(29))) * step[k]
        n = n_of[full]
        at = np.repeat(borders[:-1][full] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        to = np.repeat(out_borders[:-1][full] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[to] = mix(rolled[at])
    for row in np.flatnonzero((counts > 0) & ~full):
        whole = words[borders[row] : borders[row + 1]]
        h = np.array([0x5851F42D4C957F2D + len(whole)], _U)
        for w in whole:
            h = mix(h ^ w) * _U(0x2545F4914F6CDD1D)
        out[out_borders[row]] = h[0]
    return out, out_borders
