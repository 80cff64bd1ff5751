"""Enhanced suffix arrays over byte strings, and the repeats that their common-prefix interval tree shows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols are bytes plus one, of 9 bits; so many fit a 63-bit key.
SYMBOL_BITS, PACKED = 9, 7


class SuffixArray:
    """Suffixes of several strings in one order, with the longest common prefix of each and the next one.

    `text` holds the strings one after another, `sizes` their lengths. A suffix ends with its string. Suffixes that are
    equal to their ends stand in the order of their places.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray):
        n = len(text)
        self.text = text
        self.end = np.repeat(np.cumsum(sizes), sizes)
        self.begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = self.end - np.arange(n)
        rank, tied = self._grouped(self._packed(n), np.arange(n), np.zeros(n, np.int32))
        levels, step = [rank], PACKED
        longest = int(sizes.max(initial=0))
        while step < longest and len(tied):
            after = np.zeros(len(tied), np.int64)
            there = self.left[tied] > step
            after[there] = rank[tied[there] + step].astype(np.int64) + 1
            rank, tied = self._grouped(rank[tied].astype(np.int64) * (n + 2) + after, tied, rank)
            levels.append(rank)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.common = self._common(levels)

    def _packed(self, n: int) -> np.ndarray:
        key = np.zeros(n, np.int64)
        symbols = self.text.astype(np.int64) + 1
        for k in range(PACKED):
            key <<= SYMBOL_BITS
            there = np.flatnonzero(self.left > k)
            key[there] |= symbols[there + k]
        return key

    @staticmethod
    def _grouped(key: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks after places `at`, which were tied in groups, are told apart by `key`: a group's rank is the number of
        suffixes before it. And the places that are still tied."""
        order = np.argsort(key)
        at, key = at[order], key[order]
        index = np.arange(len(at))
        new = np.concatenate(([True], key[1:] != key[:-1]))[: len(at)]
        old = np.concatenate(([True], rank[at][1:] != rank[at][:-1]))[: len(at)]
        ahead = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(old, index, 0))
        out = rank.copy()
        out[at] = rank[at] + ahead
        alone = new & np.concatenate((new[1:], [True]))[: len(at)]
        return out, at[~alone]

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        """common[k]: length of the common prefix of suffixes k and k + 1 of the order, found from long steps to short."""
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.left[a], self.left[b])
        found = np.zeros(len(a), np.int64)
        for k in reversed(range(len(levels))):
            open_ = np.flatnonzero(found < most)
            equal = open_[levels[k][a[open_] + found[open_]] == levels[k][b[open_] + found[open_]]]
            found[equal] = np.minimum(found[equal] + (PACKED << k), most[equal])
        for _ in range(PACKED - 1):
            open_ = np.flatnonzero(found < most)
            equal = open_[self.text[a[open_] + found[open_]] == self.text[b[open_] + found[open_]]]
            if not len(equal):
                break
            found[equal] += 1
        return found

    def repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places) of the maximal repeats of at least `least` symbols, with all their occurrences.

        A stack scan over the common prefixes visits the interval tree from its leaves. An interval is put out if the
        symbols before its occurrences differ, or one begins its string: otherwise the repeat one symbol to the left has
        the same occurrences.
        """
        order, deep = self.order, self.common >= least
        if not deep.any():
            return
        edges = np.flatnonzero(np.diff(np.concatenate(([0], deep, [0])).astype(np.int8)))
        before = np.where(order > self.begin[order], self.text[np.maximum(order, 1) - 1].astype(np.int64), -1)
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            heights, marks = self.common[first:last].tolist(), before[first : last + 1].tolist()
            stack: list[list[int]] = []  # [length, lowest index, symbol before all its occurrences or -1]
            for k, height in enumerate([*heights, 0]):
                low, mark = k, marks[k]
                while stack and stack[-1][0] > height:
                    length, low, own = stack.pop()
                    mark = mark if mark == own else -1
                    if mark == -1:
                        yield length, order[first + low : first + k + 1]
                if height and (not stack or stack[-1][0] < height):
                    stack.append([height, low, mark])
                elif height and stack[-1][2] != mark:
                    stack[-1][2] = -1
