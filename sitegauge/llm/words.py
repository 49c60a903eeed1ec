"""Words of a text as byte ranges and 64-bit marks, and marks of word windows, on whole arrays.

A word is a longest run of bytes other than blank and tab to carriage return. Its mark is a polynomial over a fixed random value
per byte, mixed at the end; words of more than ``LONG`` bytes, where such polynomials have known collisions, take a plain hash.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 256
SPAN = 1 << 18
U64 = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 & ~3 | 3  # 3 modulo 4
_UP = np.concatenate([[U64(1)], np.full(SPAN + LONG, _BASE, U64)]).cumprod(dtype=np.uint64)
_DOWN = np.concatenate([[U64(1)], np.full(SPAN + LONG, pow(_BASE, -1, 1 << 64), U64)]).cumprod(dtype=np.uint64)


def mixed(z: np.ndarray) -> np.ndarray:
    """Spread every bit of a mark over all others."""
    z = z ^ (z >> U64(30))
    z = z * U64(0xBF58476D1CE4E5B9)
    z ^= z >> U64(27)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(31)
    return z


def ranges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end (exclusive)."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _GAP[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def marks(data: bytes) -> np.ndarray:
    """One mark per word, in order."""
    starts, ends = ranges(data)
    out = np.empty(len(starts), U64)
    long = np.flatnonzero(ends - starts > LONG)
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]])
    short = np.arange(len(starts))
    if len(long):
        short = np.delete(short, long)
        starts, ends = starts[short], ends[short]
    raw, i = np.frombuffer(data, np.uint8), 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(ends, first + SPAN, "right"))
        total = np.zeros(ends[j - 1] - first + 1, U64)
        np.cumsum(_VALUE[raw[first:ends[j - 1]]] * _UP[:len(total) - 1], out=total[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[short[i:j]] = (total[b] - total[a]) * _DOWN[a]
        i = j
    return mixed(out)


def joined(left: np.ndarray, right: np.ndarray, lane: int = 0) -> np.ndarray:
    """Marks of two neighbouring stretches taken together."""
    return mixed(left * U64(0xD6E8FEB86659FD93 + 2 * lane) + right)


def window_marks(marks: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A mark for every ``size`` consecutive words; lanes give independent marks."""
    n = len(marks) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    part, width, whole, have = marks, 1, None, 0
    while size:
        if size & 1:
            whole = part if whole is None else joined(whole[:len(part) - have], part[have:], lane)
            have += width
        size >>= 1
        if size:
            part = joined(part[:-width], part[width:], lane)
            width *= 2
    return whole[:n]
