"""Words of many texts at once: cut, hashed and told apart in arrays of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from shockwell.llm.mph import mixed

#: Odd multiplier of the polynomial hashes.
BASE = 0x9E3779B97F4A7C15


def symbols(seed: int) -> np.ndarray:
    return mixed(np.arange(256, dtype=np.uint64), seed)


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for each pair, from sums of powers."""
    n = len(data) + 1
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols(33)[data] * up[:-1], dtype=np.uint64)))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64), 34)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at:at + size] is b[there:there + size], for each triple."""
    if not len(size):
        return np.zeros(0, bool)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32)
    differs = a[np.repeat((at - first).astype(np.int32), size) + place] != b[np.repeat((there - first).astype(np.int32), size) + place]
    out = np.ones(len(size), bool)
    if differs.any():
        out[np.searchsorted(first, np.flatnonzero(differs), side="right") - 1] = False
    return out


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, where, inverse): the different words data[start:end] in the order of their hashes, a place of each, and the
    number of each word's own. Equal hashes are verified; where bytes differ the words are told apart by their bytes."""
    each, where, inverse = np.unique(string_hashes(data, start, end), return_index=True, return_inverse=True)
    size, alike = end - start, where[inverse]
    ok = size == size[alike]
    ok[ok] = same_bytes(data, start[ok], data, start[alike[ok]], size[ok])
    if not ok.all():
        raw, number = data.tobytes(), {}
        odd = np.flatnonzero(~ok)
        for k in odd.tolist():
            number.setdefault(raw[start[k] : end[k]], k)
        own = {word: len(each) + n for n, word in enumerate(number)}
        inverse[odd] = [own[raw[start[k] : end[k]]] for k in odd.tolist()]
        each, where = np.concatenate((each, string_hashes(data, start[list(number.values())], end[list(number.values())]))), np.concatenate((where, list(number.values())))
        order = np.argsort(each, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        each, where, inverse = each[order], where[order], place[inverse]
    return each, where, inverse


class Memory:
    """Which number a word was given before. Words are found by hash and verified by their bytes; beyond `most_words` or
    `most_bytes` all are forgotten. A word whose hash another word holds isn't remembered."""

    def __init__(self, most_words: int, most_bytes: int):
        self.most_words, self.most_bytes = most_words, most_bytes
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.number, self.first, self.size = (np.zeros(0, np.int32) for _ in range(3))
        self.bytes = np.zeros(0, np.uint8)

    def full(self, words: int, size: int) -> bool:
        """Whether so many more words of so many bytes don't fit."""
        return len(self.hashes) + words > self.most_words or len(self.bytes) + size > self.most_bytes

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those unknown."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == end - start))
        hit = hit[same_bytes(data, start[hit], self.bytes, self.first[at[hit]], self.size[at[hit]])]
        out[hit] = self.number[at[hit]]
        return out

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, number: np.ndarray) -> None:
        """Remembers words, whose hashes come sorted."""
        held = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)] & ~held
        start, end, hashes, number = start[new], end[new], hashes[new], number[new]
        size = end - start
        first = np.cumsum(size) - size
        own = data[np.repeat(start - first, size) + np.arange(int(size.sum()))]
        at = np.searchsorted(self.hashes, hashes)
        first = first + len(self.bytes)
        self.hashes, self.number, self.first, self.size = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.number, number), (self.first, first), (self.size, size)))
        self.bytes = np.concatenate((self.bytes, own))


def parts_of(text: str, chunk: int, overlap: int | None) -> Iterator[str]:
    """A text in parts of about `chunk` characters that begin at a space; a run of more without a space is cut anywhere,
    with `overlap` characters shared, or left whole if that is None."""
    first = 0
    while len(text) - first > chunk:
        at = text.rfind(" ", first + chunk // 2, first + chunk)
        if at < 0 and overlap is None:
            at = text.find(" ", first + chunk)
            if at < 0:
                break
        cut = at if at >= 0 else first + chunk
        yield text[first:cut]
        first = cut if at >= 0 else cut - overlap
    yield text[first:]
