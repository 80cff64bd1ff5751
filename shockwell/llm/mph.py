"""A minimal perfect hash index over 64-bit keys, with stored fingerprints."""

from __future__ import annotations

import numpy as np

#: The multipliers of the public 64-bit finaliser that mixes keys.
MIX_1, MIX_2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * GOLDEN & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class PerfectIndex:
    """Maps each of n different keys to its own slot in 0 .. n - 1; slots hold a 32-bit fingerprint and a payload offset.

    Levels of bits: a key that alone hits a bit of its level is placed there, the others go on to the next level. A key's
    slot is the number of set bits before its own, from a count kept every 64 bits. A lookup costs a constant number of
    probes on average; a key that isn't in the index is refused by the fingerprint, but for one in 2**32.
    """

    def __init__(self, levels: list[int], bits: np.ndarray, prints: np.ndarray, values: np.ndarray):
        self.levels, self.bits, self.prints, self.values = levels, bits, prints, values
        self.words = np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view("<u8")
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    @staticmethod
    def build(keys: np.ndarray, values: np.ndarray) -> PerfectIndex:
        keys = keys.view(np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be different")
        left, levels, parts = keys, [], []
        while len(left):
            size = 2 * len(left) + 1
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            parts.append(hits == 1)
            left = left[hits[at] > 1]
            levels.append(size)
        bits = np.concatenate(parts) if parts else np.zeros(0, bool)
        index = PerfectIndex(levels, bits, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64))
        slots = index._slots(keys)
        index.prints[slots] = mixed(keys, 1 << 20).astype(np.uint32)
        index.values[slots] = values
        return index

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slot, first = np.full(len(keys), -1, np.int64), 0
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.levels):
            at = first + (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[open_[hit]] = self.ranks[at[hit] >> 6] + below[hit]
            open_ = open_[~hit]
            first += size
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 for keys that aren't in the index."""
        keys = keys.view(np.uint64)
        slot = self._slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == mixed(keys[ok], 1 << 20).astype(np.uint32)
        return np.where(ok, self.values[np.where(ok, slot, 0)] if len(self.values) else -1, -1)

    def dump(self) -> bytes:
        head = np.array([len(self.levels), len(self.prints), *self.levels], "<i8").tobytes()
        return head + np.packbits(self.bits, bitorder="little").tobytes() + self.prints.astype("<u4").tobytes() + self.values.astype("<i8").tobytes()

    @staticmethod
    def load(raw: bytes) -> PerfectIndex:
        n_levels, n = np.frombuffer(raw, "<i8", 2).tolist()
        levels = np.frombuffer(raw, "<i8", n_levels, 16).tolist()
        at, n_bits = 16 + 8 * n_levels, sum(levels)
        n_bytes = -(-n_bits // 8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, n_bytes, at), count=n_bits, bitorder="little").astype(bool)
        return PerfectIndex(levels, bits, np.frombuffer(raw, "<u4", n, at + n_bytes), np.frombuffer(raw, "<i8", n, at + n_bytes + 4 * n))
