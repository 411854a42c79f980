"""Static binary-fuse filters over 64-bit digests: about 9 bits a key, false positives 1 in 256."""

from __future__ import annotations

import numpy as np

from .shingles import mix


def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> np.ndarray:
    """The three cells of each key, in three consecutive segments, and so as rows of an array."""
    h = mix(keys ^ mix(np.full(1, seed, np.uint64)))
    first = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    mask = segment - 1
    return np.stack([(first + k) * segment + ((h >> np.uint64(10 * k)).astype(np.int64) & mask if segment <= 1024 else mix(h + np.uint64(k)).astype(np.int64) & mask) for k in range(3)])


def _marks(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mix(keys + np.uint64(seed)) >> np.uint64(56)).astype(np.uint8)


def _shape(n: int) -> tuple[int, int]:
    """(cells of a segment, a power of two; segments a key may begin in)."""
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 32
    return segment, max(1, -(-size // segment) - 2)


def build(keys: np.ndarray) -> bytes:
    """A filter over distinct uint64 ``keys``. All keys that own a cell alone are peeled at once, round after round, and set in reverse order."""
    n = len(keys)
    segment, count = _shape(n)
    for seed in range(1, 1000):
        cells = (count + 2) * segment
        at = _places(keys, seed, segment, count)
        degree = np.bincount(at.ravel(), minlength=cells)
        owners = sum(np.bincount(row, np.arange(n, dtype=np.float64), cells) for row in at).astype(np.int64)
        order, alive = [], n
        free = np.flatnonzero(degree == 1)
        while len(free):
            key, pick = np.unique(owners[free], return_index=True)
            cell = free[pick]
            order.append((key, cell))
            alive -= len(key)
            touched = at[:, key].ravel()
            np.subtract.at(degree, touched, 1)
            np.subtract.at(owners, touched, np.tile(key, 3))
            free = np.unique(touched[degree[touched] == 1])
        if not alive:
            table, mark = np.zeros(cells, np.uint8), _marks(keys, seed)
            for key, cell in reversed(order):
                a, b, c = at[:, key]
                table[cell] = 0
                table[cell] = mark[key] ^ table[a] ^ table[b] ^ table[c]
            return np.array([seed, segment, count], np.int64).tobytes() + table.tobytes()
        if seed % 20 == 0:
            count += 1
    raise ValueError("the keys of a filter must be distinct")


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` may be in the filter; never false for one that is."""
    seed, segment, count = np.frombuffer(filter_bytes[:24], np.int64).tolist()
    table = np.frombuffer(filter_bytes, np.uint8, offset=24)
    a, b, c = _places(keys, seed, segment, count)
    return table[a] ^ table[b] ^ table[c] == _marks(keys, seed)
