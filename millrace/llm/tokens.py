"""Vectorised words, shingles and their hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
#: An odd multiplier and its inverse modulo 2**64: a word's hash is a difference of prefix sums moved back to its start.
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES)
        made = []
        for p in (_P, _Q):
            x = np.full(size, p, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > SLICE_BYTES:  # a longer text than a slice: not kept
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, offsets from 0, bytes): whole texts, together at most limit bytes unless one is longer. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, off[at : to + 1] - off[at], data[off[at] : off[to]]
        at = to


def bounds(off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one text."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = off[:-1][off[1:] > off[:-1]]
    start[first] = inside[first]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def rows_of(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row of each byte position."""
    return np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))


def words(off: np.ndarray, data: np.ndarray, between: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and 64-bit hashes of the words of lower-cased (A-Z) texts; between: which bytes end a word."""
    starts, ends = bounds(off, ~between[data])
    if not len(starts):
        return starts, ends, starts, np.zeros(0, np.uint64)
    p, q = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    return starts, ends, rows_of(off, starts), mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def shingles(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of every run of n words; a text of fewer words (but some) has its whole sequence as one."""
    if not len(h):
        return rows, h
    count = np.bincount(rows)
    upto = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(len(h), dtype=np.uint64)
    place = np.arange(len(h)) - upto[rows]
    have = np.minimum(count[rows], n)
    whole = place + have <= count[rows]
    for k in range(n):
        on = whole & (k < have)
        at = np.flatnonzero(on)
        out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + k] + np.uint64(k + 1))
    at = np.flatnonzero(whole)
    return rows[at], out[at]


def distinct(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, hash) once, by row and hash."""
    if not len(h):
        return rows, h
    order = np.lexsort((h, rows)) if len(h) < 1000 else _by_row(rows, h)
    rows, h = rows[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[new], h[new]


def _by_row(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    return order[np.argsort(rows[order].astype(np.uint32), kind="stable")]
