"""An FM-index over runs of word ids: backward search through wavelet ranks, places from sampled suffix positions."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with the number of set bits before any position."""

    def __init__(self, bits: np.ndarray):
        padded = np.pad(bits, (0, -len(bits) % 64 + 64))
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit level per bit of the largest symbol."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        now = symbols
        for shift in reversed(range(max(1, int(largest).bit_length()))):
            bits = (now >> shift & 1).astype(bool)
            self.levels.append((shift, BitRank(bits), int(len(bits) - bits.sum())))
            now = np.concatenate([now[~bits], now[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            one = symbol >> shift & 1 == 1
            low_1, high_1 = bits.ones(low), bits.ones(high)
            low, high = np.where(one, zeros + low_1, low - low_1), np.where(one, zeros + high_1, high - high_1)
        return high - low


def suffix_array(text: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Ends of runs are all different and smaller than words, so no comparison
    goes beyond a run's end and the rounds follow the longest run's logarithm."""
    n = len(text)
    ends = int(is_end.sum())
    rank = np.empty(n, np.int64)
    rank[is_end] = np.arange(ends)
    _, dense = np.unique(text[~is_end], return_inverse=True)
    rank[~is_end] = ends + dense
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:-step] = rank[step:]
        key = rank * (n + 2) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], (key[order][1:] != key[order][:-1]).cumsum()))
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Counts and locates phrases of word ids (1 and up; 0 ends each run) in a text of runs."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        """`text` ends with 0. Positions divisible by `sample` and beginnings of runs keep their place."""
        self.text_length = len(text)
        order = suffix_array(text, text == 0)
        self.symbols = text[order - 1]  # the word before each suffix
        self.wavelet = WaveletMatrix(self.symbols, int(text.max()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))  # suffixes that begin with a smaller symbol
        begins = np.concatenate(([True], text[:-1] == 0))
        kept = (order % sample == 0) | begins[order]
        self.kept = BitRank(kept)
        self.is_kept = kept
        self.places = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases that are all of one length, found word by word from the last to the first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_length, np.int64)
        open_ = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            word = phrases[open_, column]
            known = word < len(self.first) - 1
            low[open_[~known]] = high[open_[~known]] = 0
            open_, word = open_[known], word[known]
            low[open_] = self.first[word] + self.wavelet.rank(word, low[open_])
            high[open_] = self.first[word] + self.wavelet.rank(word, high[open_])
            open_ = open_[low[open_] < high[open_]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: each walks back word by word to one whose place is kept."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.is_kept[at])
        while len(open_):
            word = self.symbols[at[open_]]
            at[open_] = self.first[word] + self.wavelet.rank(word, at[open_])
            steps[open_] += 1
            open_ = open_[~self.is_kept[at[open_]]]
        return self.places[self.kept.ones(at)] + steps
