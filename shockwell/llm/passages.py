"""Substring dedup over words: windows that an earlier document holds are removed, found by level-wise doubling.

Windows repeated at one length alone are extended to twice that length. The levels of a window of w words are a quarter of
it, a half and the whole (13: 4, 7, 13); hashes of a level come from two of the level before. So that the first level isn't
every word of the corpus, a window is looked for by one of its short windows only: the one with the smallest hash, its
anchor, which depends on the window alone. A run is all neighbouring windows of a document that share an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwell.llm.batches import released
from shockwell.llm.hot import MOST_HOT, join_hot
from shockwell.llm.mph import mixed
from shockwell.llm.repeats import _numbered, smallest
from shockwell.llm.scratch import discard, materialise

#: Words hashed at once; bytes of a text cut into words at once; different words that a worker remembers at most.
WORDS, PIECE_BYTES, MOST_WORDS = 1 << 18, 1 << 20, 500_000
#: One in SAMPLED documents shows which anchors are so frequent that their runs are dealt by their words too: those seen
#: over LEAST_SEEN times and in over a MOST_HOT-th of the sample's runs.
SAMPLED, LEAST_SEEN = 64, 20
#: A run's place: its first window * RUNS + its number of windows.
RUNS = 1 << 12
RUN = "anchor long, low long, high long, doc long, place long"
#: White space that ends a word.
BLANKS = b" \t\n\x0b\x0c\r"


def levels(window: int) -> tuple[int, int, int]:
    half = -(-window // 2)
    return -(-half // 2), half, window


def pieces_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a piece of about PIECE_BYTES at a time."""
    raw = text.encode() if isinstance(text, str) else b""
    at = 0
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        while end < len(raw) and raw[end] not in BLANKS:
            end += 1
        words = raw[at:end].split()
        if words:
            yield words
        at = end


class Vocabulary(dict):
    """Numbers of words and two 64-bit hashes of each."""

    def __init__(self) -> None:
        super().__init__()
        self.digests: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.digests)
        self.digests.append(xxhash.xxh3_128_digest(word))
        return number

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        table = np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)
        low, high = table[at, 0], table[at, 1]
        if len(self.digests) > MOST_WORDS:
            self.clear()
            self.digests = []
        return low, high


def wider(values: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Hashes of windows of `step` more words, from those of two windows, `step` words apart, that cover them."""
    return mixed(values[: len(values) - step] * np.uint64(0x9E3779B97F4A7C15) + values[step:], seed) if len(values) > step else values[:0]


def level_hashes(words: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the windows from each word on, for each of the lengths, of which none is over twice the one before."""
    out, length = [], 1
    for wanted in lengths:
        while length < wanted:
            step = min(length, wanted - length)
            words = wider(words, step, length + step)
            length += step
        out.append(words)
    return out


def _stretches(docs: list[int], texts: list[str | None], window: int) -> Iterator[tuple[list[int], list[int], list[list[bytes]]]]:
    """(documents, first words, words) of stretches of texts, gathered up to WORDS; stretches of one text share `window` - 1 words."""
    owner, first, parts, held = [], [], [], 0
    for doc, text in zip(docs, texts, strict=True):
        carry: list[bytes] = []
        at = 0
        for words in pieces_of(text):
            own = carry + words
            if len(own) >= window:
                owner.append(doc), first.append(at - len(carry)), parts.append(own)
                held += len(own)
            at += len(words)
            carry = own[len(own) - min(window - 1, len(own)) :]
            if held >= WORDS:
                yield owner, first, parts
                owner, first, parts, held = [], [], [], 0
    if parts:
        yield owner, first, parts


class Stretches:
    """Runs of windows in stretches of texts, and the hashes of their windows."""

    def __init__(self, owner: list[int], first: list[int], parts: list[list[bytes]], window: int, vocabulary: Vocabulary):
        quarter, half, _ = self.lengths = levels(window)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        low, high = vocabulary.hashes([w for p in parts for w in p])
        self.quarters, self.halves, self.low = level_hashes(low, self.lengths)
        self.high = level_hashes(high, (window,))[0]
        ends = np.repeat(np.cumsum(sizes), sizes)
        self.start = np.flatnonzero(ends - np.arange(len(low)) >= window)
        self.anchor = smallest(mixed(self.quarters, 41), window - quarter + 1)[self.start]
        part = np.repeat(np.arange(len(parts)), sizes)[self.start]
        self.doc = np.array(owner, np.int64)[part]
        self.word = self.start - (np.cumsum(sizes) - sizes)[part] + np.array(first, np.int64)[part]
        self.part = part

    def runs(self) -> pd.DataFrame:
        """RUN: a run's words are told by 128 bits, from those of its first and last windows, which cover it."""
        new = np.concatenate(([True], (np.diff(self.anchor) != 0) | (np.diff(self.part) != 0) | (np.diff(self.start) != 1)))
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(self.start)))
        last = self.start[begin + count - 1]
        low, high = (mixed(h[self.start[begin]] * np.uint64(0xBF58476D1CE4E5B9) + h[last] + count.astype(np.uint64), 42) for h in (self.low, self.high))
        anchor = mixed(self.quarters[self.anchor[begin]], 43)
        return pd.DataFrame({"anchor": anchor.view(np.int64), "low": low.view(np.int64), "high": high.view(np.int64), "doc": self.doc[begin], "place": self.word[begin] * RUNS + count})


def _settled(runs: pd.DataFrame) -> pd.DataFrame:
    """Of the runs of one gathering those that an earlier document in it holds too lose their anchor: nothing else is to be
    found out about them. So a run that very many documents hold is few rows."""
    low, high, doc = (runs[c].to_numpy() for c in ("low", "high", "doc"))
    order = np.lexsort((doc, low))
    kind = np.concatenate(([True], low[order][1:] != low[order][:-1]))
    first = order[np.maximum.accumulate(np.where(kind, np.arange(len(order)), 0))]
    later = (doc[first] < doc[order]) & (high[first] == high[order])
    again = np.zeros(len(runs), bool)
    again[order[later]] = True
    return runs.assign(anchor=runs["anchor"].astype("Int64").mask(again))


def _runs(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary()
        for batch in batches:
            for owner, first, parts in _stretches(batch["doc"].tolist(), batch["text"].tolist(), window):
                yield _settled(Stretches(owner, first, parts, window, vocabulary).runs())

    return released(run)


def _meetings(hot: np.ndarray):
    """Rows come sorted by anchor, low, high, doc and place. A run that an earlier document holds is put out without its
    anchor: it goes. Where an anchor has several kinds of runs, each kind's earliest document's runs are put out with the
    anchor: their windows are looked at. So are those of a `hot` anchor, whose kinds are in several tasks, and a kind's
    second run in one document. What is carried to the next batch are two rows: the last anchor's first and the last kind's."""
    columns = ("anchor", "low", "high", "doc", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, told = pd.DataFrame({c: np.zeros(0, np.int64) for c in columns}), np.zeros(0, bool)
        for batch in batches:
            none = batch["anchor"].isna().to_numpy()
            if none.any():
                yield pd.DataFrame({"doc": batch["doc"][none], "place": batch["place"][none], "anchor": pd.Series([None] * int(none.sum()), dtype="Int64", index=batch.index[none])})
                batch = batch[~none]
            if not len(batch):
                continue
            old = np.concatenate((np.ones(len(held), bool), np.zeros(len(batch), bool)))
            done = np.concatenate((told, np.zeros(len(batch), bool)))
            anchor, low, high, doc, place = (np.concatenate((held[c].to_numpy(np.int64), batch[c].to_numpy(np.int64))) for c in columns)
            index = np.arange(len(anchor))
            group = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            kind = group | np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            number = np.cumsum(group) - 1
            several = (np.bincount(number, kind & ~group) > 0) | np.isin(anchor[group], hot)
            first = np.maximum.accumulate(np.where(kind, index, 0))
            meets = (kind & several[number] & ~done) | (~kind & ~old & (doc == doc[first]) & (place != place[first]))
            again = ~kind & ~old & (doc != doc[first])
            out = np.flatnonzero(meets | again)
            if len(out):
                yield pd.DataFrame({"doc": doc[out], "place": place[out], "anchor": pd.Series(anchor[out], dtype="Int64").mask(again[out])})
            keep = np.unique([np.flatnonzero(group)[-1], first[-1]])
            held, told = pd.DataFrame({c: x[keep] for c, x in zip(columns, (anchor, low, high, doc, place), strict=True)}), (done | meets)[keep]

    return released(run)


def _halves(window: int):
    """The windows of the runs that met, by their half: the half that begins with the run's anchor, or, where that would end
    beyond the window, the window's last one. A row has a half's hash and the windows it stands for, neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary()
        for batch in batches:
            wanted = dict(zip(batch["doc"].tolist(), batch["places"], strict=True))
            for owner, first, parts in _stretches(batch["doc"].tolist(), batch["text"].tolist(), window):
                found = Stretches(owner, first, parts, window, vocabulary)
                half = found.lengths[1]
                at = np.minimum(found.anchor, found.start + window - half)
                asked = np.zeros(len(found.start) + 1, np.int64)
                for a, b in zip(*_edges(found.part), strict=True):
                    place, count = np.divmod(np.asarray(wanted[int(found.doc[a])]), RUNS)
                    np.add.at(asked, a + np.searchsorted(found.word[a:b], place), 1)
                    np.add.at(asked, a + np.searchsorted(found.word[a:b], place + count), -1)
                keep = np.flatnonzero(np.cumsum(asked[:-1]) > 0)
                if not len(keep):
                    continue
                new = np.concatenate(([True], (np.diff(at[keep]) != 0) | (np.diff(keep) != 1)))
                begin = np.flatnonzero(new)
                ends = np.append(begin[1:], len(keep))
                low, high = found.low[found.start[keep]].view(np.int64), found.high[found.start[keep]].view(np.int64)
                yield pd.DataFrame({
                    "half": mixed(found.halves[at[keep[begin]]], 44).view(np.int64), "doc": found.doc[keep[begin]], "first": found.word[keep[begin]],
                    "low": [low[a:b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], "high": [high[a:b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)],
                })

    return released(run)


def _edges(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))[: len(values)]).tolist()
    return begin, [*begin[1:], len(values)]


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, earliest) of the keys that several documents hold."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("doc").alias("earliest"), F.max("doc").alias("latest")).where("earliest != latest").drop("latest")


def _without(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                total, lost, kept, starts, ends = [], [], [], [], []
                for text, spans in zip(part["text"], part["spans"], strict=True):
                    merged: list[list[int]] = []
                    for a, b in sorted((p // RUNS, p // RUNS + p % RUNS + window - 1) for p in (spans.tolist() if spans is not None else ())):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    n, left, own = 0, [], iter([*merged, [1 << 62, 1 << 62]])
                    a, b = next(own)
                    for words in pieces_of(text):
                        at = 0
                        while at < len(words):  # a piece is cut at the spans' edges
                            if n + at >= b:
                                a, b = next(own)
                            elif n + at >= a:
                                at = min(len(words), b - n)
                            else:
                                left += words[at : min(len(words), a - n)]
                                at = min(len(words), a - n)
                        n += len(words)
                    total.append(n), lost.append(n - len(left)), kept.append(b" ".join(left).decode()), starts.append([x[0] for x in merged]), ends.append([x[1] for x in merged])
                yield pd.DataFrame({"id": part["id"].astype("Int64").array, "n_words": total, "n_removed": lost, "starts": starts, "ends": ends, "kept_text": kept})

    return released(run)


def remove_passages(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, starts, ends, kept_text): the spans of each text's words that windows of `window` words cover
    which also start in a document of a smaller id, and the words that stay, joined by single spaces.

    1. Quarter: texts' runs, with the hash of their anchor and 128 bits of their words, are dealt by anchor and read in
       order. Of equal runs all go but those of the earliest document; where an anchor has different runs they go on.
    2. Half: for the windows of those runs, the half that holds the anchor. Halves that one document alone holds end here.
    3. Whole: the windows of halves that several documents hold, told by 128 bits; those that an earlier document holds
       go. Longer levels could find no window that this one doesn't, so it is the last.
    4. Spans return to their texts.

    No task holds a group: step 1 reads it as a stream, and sorts out equal runs before the shuffle; steps 2 and 3 count
    before the shuffle and leave rows of frequent keys where they are. Anchors that show often in one of SAMPLED documents
    (at most 4000 can) are dealt by their runs' words too; which those are depends on the sample, the result doesn't.

    Words are what ASCII white space separates, unchanged. Null text: no words, kept_text empty. Texts under `window` words
    lose nothing; longer ones are read whole, about a megabyte at a time. Null ids sort first; different texts with one id
    are different documents, in the order of their digests; rows alike in id and text are one document, and each gets its
    answer. Ids are integers. An empty table gives no rows; other columns are ignored.
    """
    if not 4 <= window < RUNS // 2:
        raise ValueError(f"window must be 4 to {RUNS // 2 - 1}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    texts = _numbered(rows)
    read = texts.select("doc", "text")
    sample = read.where(F.pmod(F.xxhash64("doc", F.lit(6)), F.lit(SAMPLED)) == 0).mapInPandas(_runs(window), RUN).where("anchor is not null")
    seen = materialise(sample.groupBy("anchor").agg(F.count("*").alias("n")), "anchors")
    often = max(LEAST_SEEN, int(seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // MOST_HOT)
    hot = sorted(r["anchor"] for r in seen.where(F.col("n") > often).collect())
    discard(seen)
    deal = F.when(F.col("anchor").isNull(), F.xxhash64("doc", "place"))
    deal = (deal.when(F.col("anchor").isin(hot), F.xxhash64("anchor", "low")) if hot else deal).otherwise(F.col("anchor"))
    dealt = read.mapInPandas(_runs(window), RUN).repartition(deal).sortWithinPartitions("anchor", "low", "high", "doc", "place")
    met = materialise(dealt.mapInPandas(_meetings(np.array(hot, np.int64)), "doc long, place long, anchor long"), "meetings")
    places = met.where("anchor is not null").groupBy("doc").agg(F.collect_set("place").alias("places"))
    halves = materialise(read.join(places, "doc").mapInPandas(_halves(window), "half long, doc long, first long, low array<long>, high array<long>"), "halves")
    half = materialise(_repeated(halves, "half").drop("earliest"), "half")
    alive = join_hot(halves, half, "half", "n", halves.count())
    each = alive.select("doc", "first", F.posexplode(F.arrays_zip("low", "high")).alias("k", "window"))
    windows = materialise(each.select(F.struct("window.low", "window.high").alias("key"), "doc", (F.col("first") + F.col("k")).alias("first")), "windows")
    whole = materialise(_repeated(windows, "key"), "whole")
    late = join_hot(windows, whole, "key", "n", windows.count()).where("doc > earliest").select("doc", (F.col("first") * RUNS + 1).alias("place"))
    spans = reduce(DataFrame.unionByName, [met.where("anchor is null").select("doc", "place"), late]).groupBy("doc").agg(F.collect_list("place").alias("spans"))
    done = texts.join(spans, "doc", "left").select("id", "text", "spans").mapInPandas(_without(window), "id long, n_words long, n_removed long, starts array<long>, ends array<long>, kept_text string")
    return done.withColumnRenamed("id", id_col)
