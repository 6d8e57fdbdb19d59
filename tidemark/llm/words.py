"""Words of many texts at once, hashed in numpy: words are runs of bytes other than space and \\t\\n\\v\\f\\r, unchanged."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of texts handled at a time, beyond a single text, and bytes hashed at a time, beyond a single word.
PORTION, CHUNK = 1_000_000, 1 << 18
#: An odd multiplier, its inverse modulo 2**64, and multipliers for mixing.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 0xD6E8FEB86659FD93

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p))
    return both[0], both[1]


def portions(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """from, to, bytes and offsets of some texts at a time; a null has no bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PORTION, "right")) - 1)
        stop = min(stop, len(column))
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)  # where a text begins
    fresh[offsets] = True
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (edge | fresh[:-1]))
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (last | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        low = int(starts[a])
        part = data[low : int(ends[b - 1])]
        powers, inverses = _chunk_powers() if len(part) <= CHUNK else _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=sums[1:])
        own, end = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((sums[end] - sums[own]) * inverses[own] + (end - own).astype(np.uint64))
        a = b
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words (len(words) - n + 1 of them, across texts too)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(STEP)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)
