"""Suffix-array dedup: byte strings that occur before are removed, found as maximal repeats of enhanced suffix arrays.

A suffix array of the whole corpus fits no task, so its suffixes are dealt out first. Of the grams in a string of `least`
bytes the one with the smallest hash is its anchor, which depends on nothing but the string: equal strings have equal
anchors at equal places. A segment is a run of strings of one document that share an anchor. Segments with equal anchors
meet in one task, where a suffix array over their bytes shows the repeats; anchors that occur once leave no work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwell.llm.hot import MOST_HOT, join_hot
from shockwell.llm.mph import mixed
from shockwell.llm.scratch import discard, materialise
from shockwell.llm.suffixes import SuffixArray
from shockwell.llm.words import BASE, string_hashes, symbols

#: Bytes of text hashed at once; bytes of segments under one suffix array; a larger group of one anchor goes by hashes of its strings.
SLICE_BYTES, ARRAY_BYTES, GROUP_BYTES = 1 << 20, 1 << 20, 8 << 20
#: Bytes of text hashed at once; bytes of segments under one suffix array; a larger group of one anchor goes by hashes of its strings.
SLICE_BYTES, ARRAY_BYTES, GROUP_BYTES = 1 << 20, 1 << 20, 8 << 20
#: One in SAMPLED documents shows which anchors are so frequent that their segments are dealt by their bytes too: those
#: seen over LEAST_SEEN times and in over a MOST_HOT-th of the sample's segments.
SAMPLED, LEAST_SEEN = 64, 20
#: A segment's place: start * RUNS + number of strings in it.
RUNS = 1 << 12


def gram_size(least: int) -> int:
    """The largest power of two up to a third of a string."""
    return 1 << (max(least // 3, 1).bit_length() - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes (a power of two) from each place on, from two halves each time."""
    out, step, factor = symbols(31)[data], 1, BASE
    while step < size:
        out = out[:-step] * np.uint64(factor) + out[step:]
        step, factor = 2 * step, factor * factor & (1 << 64) - 1
    return mixed(out, 32)


def smallest(values: np.ndarray, spread: int) -> np.ndarray:
    """Place of the first smallest value among `spread` values from each place on."""
    at = np.arange(len(values), dtype=np.int32)

    def merge(value: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        later = value[step:] < value[:-step] if step else np.zeros(len(value), bool)
        n = len(value) - step
        return np.where(later, value[step:], value[:n]), np.where(later, at[step:], at[:n])

    value, step = values, 1
    while 2 * step <= spread:
        value, at = merge(value, at, step)
        step *= 2
    return merge(value, at, spread - step)[1]


def other_hashes(values: np.ndarray, gram: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of each text[start:end], from the hashes of grams that lie evenly in it, the last one at its end."""
    out = np.zeros(len(start), np.uint64)
    steps = -(-(end - start - gram) // gram)
    for k in range(int(steps.max(initial=0)) + 1):
        there = k <= steps
        out[there] = mixed(out[there] ^ values[np.minimum(start[there] + k * gram, end[there] - gram)], 36)
    return out


def segments(data: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, anchor, hash, second hash) of the segments in texts that stand one after another in `data`."""
    gram = gram_size(least)
    ends = np.repeat(np.cumsum(sizes), sizes)
    start = np.flatnonzero(ends - np.arange(len(data)) >= least)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    values = gram_hashes(data, gram)
    anchor = smallest(values, least - gram + 1)[start]
    new = np.concatenate(([True], (np.diff(start) != 1) | (np.diff(anchor) != 0) | (ends[start][1:] != ends[start][:-1])))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    end = begin + count - 1 + least
    whole, check = string_hashes(data, begin, end), other_hashes(values, gram, begin, end)
    return begin, count, values[anchor[first]].view(np.int64), whole.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _slices(ids: list, texts: list, least: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts' bytes, cut into parts that overlap by `least` - 1 and gathered up to SLICE_BYTES."""
    owner, base, parts, held = [], [], [], 0
    for i, text in zip(ids, texts, strict=True):
        raw = text.encode() if isinstance(text, str) else b""
        for k in range(0, max(1, len(raw) - least + 1), SLICE_BYTES):
            part = raw[k : k + SLICE_BYTES + least - 1]
            if len(part) >= least:
                owner.append(i), base.append(k), parts.append(part)
                held += len(part)
                if held >= SLICE_BYTES:
                    yield owner, base, parts
                    owner, base, parts, held = [], [], [], 0
    if parts:
        yield owner, base, parts


def _segments(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for owner, base, parts in _slices(batch["doc"].tolist(), batch["text"].tolist(), least):
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                begin, count, anchor, whole, check = segments(np.frombuffer(b"".join(parts), np.uint8), sizes, least)
                firsts = np.cumsum(sizes) - sizes
                part = np.searchsorted(firsts, begin, side="right") - 1
                place = (begin - firsts[part] + np.array(base)[part]) * RUNS + count
                yield pd.DataFrame({"anchor": anchor, "whole": whole, "check": check, "doc": np.array(owner, np.int64)[part], "place": place})

    return run


def _meetings(hot: np.ndarray):
    """Rows come sorted by anchor, whole, check, doc and place. A segment equal to an earlier one is put out without its
    anchor: all of it occurs before. The first of each kind is put out with the anchor if the anchor has several kinds, or
    is one of the `hot` ones, whose kinds are in several tasks. What is carried to the next batch are two rows: the last
    anchor's first segment and the last kind's first."""
    columns = ("anchor", "whole", "check", "doc", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, told = pd.DataFrame({c: np.zeros(0, np.int64) for c in columns}), np.zeros(0, bool)
        for batch in batches:
            if not len(batch):
                continue
            old = np.concatenate((np.ones(len(held), bool), np.zeros(len(batch), bool)))
            done = np.concatenate((told, np.zeros(len(batch), bool)))
            anchor, whole, check, doc, place = (np.concatenate((held[c], batch[c])) for c in columns)
            index = np.arange(len(anchor))
            group = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            kind = group | np.concatenate(([True], (whole[1:] != whole[:-1]) | (check[1:] != check[:-1])))
            number = np.cumsum(group) - 1
            several = (np.bincount(number, kind & ~group) > 0) | np.isin(anchor[group], hot)
            meets = kind & several[number] & ~done
            first = np.maximum.accumulate(np.where(kind, index, 0))
            again = ~kind & ~old & ((doc != doc[first]) | (place != place[first]))
            out = np.flatnonzero(meets | again)
            if len(out):
                yield pd.DataFrame({"doc": doc[out], "place": place[out], "anchor": pd.Series(anchor[out], dtype="Int64").mask(again[out])})
            keep = np.unique([np.flatnonzero(group)[-1], first[-1]])
            held, told = pd.DataFrame({c: x[keep] for c, x in zip(columns, (anchor, whole, check, doc, place), strict=True)}), (done | meets)[keep]

    return run


def _cut(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: dict[str, list] = {"anchor": [], "doc": [], "start": [], "data": []}
            for doc, text, meets in zip(batch["doc"], batch["text"], batch["meets"], strict=True):
                raw = text.encode()
                for m in meets:
                    start, count = divmod(m["place"], RUNS)
                    rows["anchor"].append(m["anchor"]), rows["doc"].append(doc), rows["start"].append(start)
                    rows["data"].append(raw[start : start + count - 1 + least])
            yield pd.DataFrame(rows)

    return run


def covered(text: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in `text` of what repeats cover: every occurrence but a repeat's first, which is the smallest place.

    Strings stand in the order of their documents and places. Bottom-up, an occurrence leaves with its longest repeat.
    """
    array = SuffixArray(text, sizes)
    open_ = np.ones(len(text), bool)
    starts, lengths = [], []
    for length, places in array.repeats(least):
        own = places[open_[places]]
        own = own[own != places.min()]
        open_[own] = False
        starts.append(own), lengths.append(np.full(len(own), length))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    end = start + np.concatenate(lengths)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    string = array.end[start] if len(start) else start
    new = np.concatenate(([True], (start[1:] > end[:-1]) | (string[1:] != string[:-1])))[: len(start)]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)] if len(start) else end


def _arrays(least: int, array_bytes: int, group_bytes: int):
    schema = ["doc", "start", "end", "anchor", "string", "other"]

    def emit(rows: list[tuple]) -> pd.DataFrame:
        sizes = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
        start, end = covered(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), sizes, least)
        firsts = np.cumsum(sizes) - sizes
        own = np.searchsorted(firsts, start, side="right") - 1
        shift = np.array([r[2] for r in rows], np.int64)[own] - firsts[own]
        none = pd.Series([None] * len(start), dtype="Int64")
        return pd.DataFrame({"doc": np.array([r[1] for r in rows], np.int64)[own], "start": start + shift, "end": end + shift, "anchor": none, "string": none, "other": none})

    def strings(rows: list[tuple]) -> pd.DataFrame:
        sizes = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
        data, count = np.frombuffer(b"".join(r[3] for r in rows), np.uint8), sizes - least + 1
        own = np.repeat(np.arange(len(rows)), count)
        within = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        at = (np.cumsum(sizes) - sizes)[own] + within
        start = np.array([r[2] for r in rows], np.int64)[own] + within
        found = string_hashes(data, at, at + least).view(np.int64)
        other = other_hashes(gram_hashes(data, gram_size(least)), gram_size(least), at, at + least).view(np.int64)
        return pd.DataFrame({"doc": np.array([r[1] for r in rows], np.int64)[own], "start": start, "end": start + least, "anchor": rows[0][0], "string": found, "other": other})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by anchor, document and place."""
        closed: list[tuple] = []  # segments of whole groups
        group: list[tuple] = []  # of the group now read
        held = own = 0
        large = last = None
        for batch in batches:
            for row in zip(batch["anchor"].tolist(), batch["doc"].tolist(), batch["start"].tolist(), batch["data"], strict=True):
                if group and row[0] != group[0][0]:
                    if large == group[0][0]:
                        yield strings(group)[schema]
                    else:
                        closed += group
                        held += own
                    group, own = [], 0
                    if held >= array_bytes:
                        yield emit(closed)[schema]
                        closed, held = [], 0
                if row[:3] == last:  # a row that the table repeats
                    continue
                last = row[:3]
                group.append(row)
                own += len(row[3])
                if own >= group_bytes:
                    large = row[0]
                    yield strings(group)[schema]
                    group, own = [], 0
        if group and large == group[0][0]:
            yield strings(group)[schema]
        else:
            closed += group
        if closed:
            yield emit(closed)[schema]

    return run


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        size, starts, ends, kept = [], [], [], []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            raw = text.encode() if isinstance(text, str) else b""
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans) if spans is not None else ():
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            edges = [0, *(x for span in merged for x in span), len(raw)]
            size.append(len(raw)), starts.append([x[0] for x in merged]), ends.append([x[1] for x in merged])
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield batch.drop(columns=["doc", "spans"]).assign(n_bytes=size, starts=starts, ends=ends, kept=kept)


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with doc, a long in the order of the documents: the id itself, unless ids are null or shared by different
    texts; then the rank-like number of the pair of id and the text's digest."""
    odd = rows.groupBy("id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("id is null or a != b")
    if odd.isEmpty():
        return rows.select("id", "text", F.col("id").alias("doc"))
    numbers = materialise(rows.select("id", "mark").distinct().orderBy("id", "mark").withColumn("doc", F.monotonically_increasing_id()), "numbers")
    both = rows.join(numbers.withColumnsRenamed({"id": "own", "mark": "own_mark"}), F.col("id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark")))
    return both.select("id", "text", "doc")


def remove_repeats(docs: DataFrame, least: int = 100, array_bytes: int = ARRAY_BYTES, group_bytes: int = GROUP_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_bytes, starts, ends, kept): the spans of each text's UTF-8 bytes that strings of at least `least`
    bytes cover which also start earlier (in a smaller id, or before in the same text), and the bytes that stay.

    1. Each text's segments, with hashes of their anchor and of all their bytes, are dealt by anchor and read in order.
       Segments equal to an earlier one are removed outright; other anchors that occur more than once go on.
    2. The bytes of those segments, cut from the texts, are dealt by anchor again. Groups are gathered to about
       `array_bytes` and a suffix array over them gives maximal repeats with all occurrences; all but the first go.
    3. A group of over `group_bytes` fits no task. It leaves as two 64-bit hashes of each of its strings, and the first
       of each string is found by a combined minimum.
    4. Spans return to their texts.

    Equal bytes are told by comparison in step 2; in steps 1 and 3 by two hashes of different make, of 160 bits with the
    anchor's in step 1 and 128 in step 3. No task holds a group: steps 1 and 3 read it as a stream. Anchors that show often
    in one of SAMPLED documents (at most 4000 can) are dealt by the segment's hash too, so that none fills a task; which
    are depends on the sample, the result doesn't. Null text: no bytes. Null ids sort first; different texts with one id
    are different documents, in the order of their digests; rows alike in id and text are one document, and each gets its
    answer. Texts shorter than `least` lose nothing, longer ones are read whole. An empty table gives no rows; other
    columns are ignored.
    """
    if least < 8 or least >= RUNS:
        raise ValueError(f"least must be 8 to {RUNS - 1}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    texts = _numbered(rows)
    names = "anchor long, whole long, check int, doc long, place long"
    sample = texts.where(F.pmod(F.xxhash64("doc", F.lit(6)), F.lit(SAMPLED)) == 0).select("doc", "text").mapInPandas(_segments(least), names)
    seen = materialise(sample.groupBy("anchor").agg(F.count("*").alias("n")), "anchors")
    often = max(LEAST_SEEN, int(seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // MOST_HOT)
    hot = sorted(r["anchor"] for r in seen.where(F.col("n") > often).collect())
    discard(seen)
    deal = F.when(F.col("anchor").isin(hot), F.xxhash64("anchor", "whole")).otherwise(F.col("anchor")) if hot else F.col("anchor")
    dealt = texts.select("doc", "text").mapInPandas(_segments(least), names).repartition(deal).sortWithinPartitions("anchor", "whole", "check", "doc", "place")
    met = materialise(dealt.mapInPandas(_meetings(np.array(hot, np.int64)), "doc long, place long, anchor long"), "meetings")
    several = met.where("anchor is not null").groupBy("doc").agg(F.collect_set(F.struct("anchor", "place")).alias("meets"))
    cut = texts.select("doc", "text").join(several, "doc").mapInPandas(_cut(least), "anchor long, doc long, start long, data binary")
    arrays = cut.repartition("anchor").sortWithinPartitions("anchor", "doc", "start")
    found = materialise(arrays.mapInPandas(_arrays(least, array_bytes, group_bytes), "doc long, start long, end long, anchor long, string long, other long"), "repeats")
    strings = found.where("anchor is not null").withColumn("key", F.struct("anchor", "string", "other")).select("key", "doc", "start", "end")
    firsts = strings.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    spans = reduce(
        DataFrame.union,
        [
            met.where("anchor is null").select("doc", F.floor(F.col("place") / RUNS).alias("start"), (F.floor(F.col("place") / RUNS) + F.col("place") % RUNS - 1 + least).alias("end")),
            found.where("anchor is null").select("doc", "start", "end"),
            join_hot(strings, firsts, "key", "n", strings.count()).where(F.struct("doc", "start") != F.col("first")).select("doc", "start", "end"),
        ],
    )
    each = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    done = texts.join(each, "doc", "left").mapInPandas(_without, "id long, text string, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return done.withColumnsRenamed({"id": id_col, "text": text_col})
