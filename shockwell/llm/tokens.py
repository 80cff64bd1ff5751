"""Token ids of whole texts, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from shockwell.llm.words import Memory, distinct, parts_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words, their bytes and ids that a worker remembers at most, then it starts anew. Words encoded at once; bytes of text looked up at once.
MOST_WORDS, MOST_BYTES, MOST_IDS, AT_ONCE, CHUNK = 800_000, 8 << 20, 4_000_000, 4000, 1 << 19
#: What keeps a text from being cut into words: white space but single spaces and newlines, and white space at the end.
ODD = re.compile(r"[^\S \n]|[ \n](?:[ \n]|\Z)")


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library.

    Byte-level BPE cuts a text into words before it merges, and always before a single space, and around a single
    newline, between two other characters. So words cut there have the ids they have in the whole text; each different
    word is encoded once and remembered: it is found by a hash and verified by its bytes. Other texts, and those with a
    run of over CHUNK characters without a space, are encoded as a whole. A test holds this against encoding whole texts.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space or a newline
        self.begins[[i for word, i in vocabulary.items() if word[:1] in "ĠĊ"]] = True
        self.memory = Memory(most_words, MOST_BYTES * most_words // MOST_WORDS)
        self.most_ids = MOST_IDS * most_words // MOST_WORDS
        self.forget()

    def forget(self) -> None:
        self.memory.forget()
        self.first, self.count, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Many words as one text; each one's ids begin with one for a space or a newline, which bare words are lent."""
        lent = np.array([w[0] not in " \n" for w in words])
        ids = self._whole(["".join(["\n" + w if x else w for w, x in zip(words, lent.tolist(), strict=True)])])[0]
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):
            return self._whole(words)
        ends = np.append(starts[1:], len(ids)).tolist()
        return [ids[a:b] for a, b in zip((starts + lent).tolist(), ends, strict=True)]

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of words, a chunk's worth."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        new = (data == 32) | (data == 10)
        new[begin[sizes > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(data))[: len(start)]
        each, where, inverse = distinct(data, start, end)
        a, b = start[where], end[where]
        number = self.memory.find(data, a, b, each)
        unknown = number < 0
        if unknown.any() and (self.memory.full(int(unknown.sum()), int((b - a)[unknown].sum())) or len(self.ids) > self.most_ids):
            self.forget()
            number, unknown = np.full(len(each), -1), np.ones(len(each), bool)
        if unknown.any():
            raw = data.tobytes()
            words = [raw[x:y].decode() for x, y in zip(a[unknown].tolist(), b[unknown].tolist(), strict=True)]
            found = [x for k in range(0, len(words), AT_ONCE) for x in self._words(words[k : k + AT_ONCE])]
            count = np.fromiter(map(len, found), np.int64, len(found))
            number[unknown] = len(self.first) + np.arange(len(found))
            self.first = np.concatenate((self.first, (len(self.ids) + np.cumsum(count) - count).astype(np.int32)))
            self.count, self.ids = np.concatenate((self.count, count.astype(np.int32))), np.concatenate([self.ids, *found])
            self.memory.add(data, a[unknown], b[unknown], each[unknown], number[unknown])
        first, count = (x[number][inverse].astype(np.int64) for x in (self.first, self.count))
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        token = np.concatenate((np.zeros(1, np.int64), ends))
        cut = token[np.searchsorted(start, np.append(begin, len(data)))] * self.width
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    @staticmethod
    def _parts(text: str) -> list[bytes] | None:
        """A text of words in parts of at most a chunk that begin at a space; None if it must be encoded as a whole."""
        if ODD.search(text):
            return None
        parts = list(parts_of(text, CHUNK, None))
        return [p.encode() for p in parts] if max(map(len, parts)) <= CHUNK else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, self.width bytes each."""
        parts = [self._parts(t) for t in texts]
        queue, held, found = [], 0, []
        for part in (p for own in parts for p in own or ()):
            queue.append(part)
            held += len(part)
            if held >= CHUNK:
                found += self._looked_up(queue)
                queue, held = [], 0
        found += self._looked_up(queue) if queue else []
        ids = iter(found)
        return [self._whole([t])[0].tobytes() if own is None else b"".join(next(ids) for _ in own) for t, own in zip(texts, parts, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, most_words: int = MOST_WORDS) -> Encoder:
    return Encoder(path, most_words)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
