"""Names of a chunk by the characters they have: bounds of a ratio of matching blocks that rule out nearly all names without comparing them."""

from __future__ import annotations

import difflib

import numpy as np

#: Characters are counted in classes; digits have their own, and are kept apart from the rest, as names of a series differ in them only.
CLASSES, DIGITS = 128, range(48, 58)
#: Names are compared from the highest bound down, first those within ``GAP`` of the top. Longer labels than ``WORD`` have no bound by common subsequence.
GAP, WORD = 0.06, 64


def codes(names: list[str]) -> np.ndarray:
    return (np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES).astype(np.uint8)


def counts(names: list[str], step: int = 8_192) -> np.ndarray:
    """How often each name has each class."""
    out = np.zeros((len(names), CLASSES), np.uint16 if max(map(len, names), default=0) < 1 << 16 else np.uint32)
    for k in range(0, len(names), step):
        part = names[k : k + step]
        at = np.repeat(np.arange(len(part)) * CLASSES, [len(x) for x in part]) + codes(part)
        out[k : k + step] = np.bincount(at, minlength=len(part) * CLASSES).reshape(len(part), CLASSES)
    return out


def split(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts without digits, and those of digits."""
    rest = table.copy()
    rest[:, DIGITS.start : DIGITS.stop] = 0
    return rest, np.ascontiguousarray(table[:, DIGITS.start : DIGITS.stop])


def distinct(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and which of them each row is."""
    used = np.ascontiguousarray(table[:, table.any(0)])
    if not used.size:
        return table[:1], np.zeros(len(table), np.int64)
    _, at, of = np.unique(used.view(np.dtype((np.void, used.itemsize * used.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return table[at], of.ravel()


def common(columns: np.ndarray, own: np.ndarray, at=slice(None)) -> np.ndarray:
    """What each of the names, given as counts by class, can have in common with ``own`` at most."""
    out = np.zeros(columns.shape[1], np.int64)[at]
    for k in np.flatnonzero(own):
        out += np.minimum(columns[k][at], own[k])
    return out


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges given, one after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def bound(shared: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)


class Chunk:
    """Names, the distinct counts of letters and of digits that they have, and for each pair of these (a row) its names."""

    def __init__(self, names: list[str]):
        rest, digits = split(counts(names))
        (letters, of), (digits, with_) = distinct(rest), distinct(digits)
        self.letters, self.digits = np.ascontiguousarray(letters.T), np.ascontiguousarray(digits.T)
        self.length = letters.sum(1, dtype=np.int64)
        pair = of * len(digits) + with_
        order = np.argsort(pair, kind="stable")
        row, first = np.unique(pair[order], return_index=True)
        self.names = [names[k] for k in order]
        self.first = np.append(first, len(names))
        self.row_letters, self.row_digits = row // len(digits), row % len(digits)
        self.row_length = self.length[self.row_letters] + digits.sum(1, dtype=np.int64)[self.row_digits]
        self.of_letters = np.searchsorted(self.row_letters, np.arange(len(letters) + 1))
        self.size = np.array([len(x) for x in self.names], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.flat = np.full(int(self.size.sum()) + len(names), CLASSES, np.uint8)  # a class that no label has ends a name
        self.flat[ranges(self.start, self.start + self.size)] = codes(self.names)

    def top(self, letters: np.ndarray) -> float:
        """The highest bound by letters alone."""
        return bound(common(self.letters, letters), letters.sum() + self.length).max()

    def reach(self, shared: np.ndarray, letters: int, digits, bar) -> np.ndarray:
        """Which letters' names, sharing ``shared`` of theirs, can come up to ``bar``; at best they have the label's digits."""
        return bound(shared + digits, letters + self.length + 2 * digits) >= bar

    def subsequences(self, low: str, some: np.ndarray) -> np.ndarray:
        """The lengths of the longest common subsequences of classes, of a label of up to 64 characters and some names; bit-parallel over its characters."""
        masks = np.zeros(CLASSES + 1, np.uint64)
        for k, c in enumerate(codes([low])):
            masks[c] |= np.uint64(1 << k)
        state = np.full(len(some), (1 << 64) - 1, np.uint64)
        start, size = self.start[some], self.size[some]
        for k in range(int(size.max())):
            has = masks[self.flat[start + np.minimum(k, size)]]
            both = state & has
            state = (state + both) | (state - both)
        return np.bitwise_count(~state & np.uint64((1 << len(low)) - 1)).astype(np.int64)

    def search(self, low: str, digits: np.ndarray, letters: int, shared: np.ndarray, best: list[tuple[float, str]], n: int, cutoff: float) -> None:
        """Puts what is among the n best into ``best``, (ratio, name) from the best down."""
        bar = lambda: best[-1][0] if len(best) == n else cutoff
        some = np.flatnonzero(self.reach(shared, letters, int(digits.sum()), bar()))
        rows = ranges(self.of_letters[some], self.of_letters[some + 1])
        if not len(rows):
            return
        bounds = bound(shared[self.row_letters[rows]] + common(self.digits, digits, self.row_digits[rows]), len(low) + self.row_length[rows])
        high, top, gap, matcher = np.inf, bounds.max(), GAP, difflib.SequenceMatcher(None, "", low)
        while high > bar() and top >= bar():
            floor = max(bar(), top - gap)
            now = rows[(bounds >= floor) & (bounds < high)]
            if len(now):
                self._compare(low, matcher, ranges(self.first[now], self.first[now + 1]), best, bar, n, cutoff)
            high, gap = floor, 2 * gap

    def _compare(self, low: str, matcher: difflib.SequenceMatcher, some: np.ndarray, best: list, bar, n: int, cutoff: float) -> None:
        for k in range(0, len(some), 1 << 16):
            part = some[k : k + (1 << 16)]
            bounds = bound(self.subsequences(low, part), len(low) + self.size[part]) if 0 < len(low) <= WORD else np.ones(len(part))
            left = bounds >= bar()
            part, bounds = part[left], bounds[left]
            for level in np.unique(bounds)[::-1]:
                if level < bar():
                    break
                for name in sorted((self.names[at] for at in part[bounds == level]), reverse=True):
                    if len(best) == n and (level, name) < best[-1]:
                        break
                    matcher.set_seq1(name)
                    ratio = matcher.ratio()
                    if ratio >= cutoff:
                        best.append((ratio, name))
                        best.sort(reverse=True)
                        del best[n:]
