"""Word-shingle sets of whole texts as sorted 64-bit hash arrays, computed on Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text hashed at a time; working memory is about 40 times this, or that of the longest single text.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words (runs of non-blank bytes, A-Z folded, cut at ``at``) in texts that lie one after another: hashes, first bytes, last bytes."""
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    where = np.flatnonzero(word)
    begin = np.searchsorted(where, starts)
    inside = where - np.repeat(starts, np.diff(begin, append=len(where)))
    value = _FOLD[data[where]] * _powers(int(inside.max()) + 1)[inside]
    return mix(np.add.reduceat(value, begin)), starts, where[np.append(begin[1:], len(where)) - 1]


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in order, about ``CHUNK`` bytes at a time: the bytes, and where each text begins and the last ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        yield data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of ``words`` words; with fewer words the whole sequence as one; none without words or text."""
    for data, at in chunks(texts):
        hashes, starts, _ = word_hashes(data, at)
        count = np.searchsorted(starts, at)
        runs = hashes[: max(0, len(hashes) - words + 1)].copy()
        for k in range(1, words):
            runs = mix(runs * np.uint64(_BASE) + hashes[k : k + len(runs)])
        for a, b in zip(count[:-1].tolist(), count[1:].tolist()):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for h in hashes[a:b]:
                    whole = mix(whole * np.uint64(_BASE) + h)
                yield whole
            else:
                yield np.zeros(0, np.uint64)
