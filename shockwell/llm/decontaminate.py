"""Benchmark decontamination: test phrases are searched in an FM-index of each training shard."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockwell.llm.batches import ARROW, append_columns, fresh, released
from shockwell.llm.fmindex import FMIndex
from shockwell.llm.scratch import materialise

#: Fixed value: a word is a run of ASCII letters and digits and of all characters beyond ASCII.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Words that one FM-index holds at least; a shard is closed once it has so many. Bytes of benchmark text searched in one pass.
SHARD_WORDS = 400_000
PASS_BYTES = 4 << 20
#: Words of an item that travel together; longer items are cut, with windows that overlap the cut on both sides.
PIECE_WORDS = 20_000
#: Columns that the search adds.
FOUND = {"n_words": "long", "starts": "array<int>", "ends": "array<int>", "items": "array<string>"}
TYPES = [ARROW[t] for t in FOUND.values()]


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if isinstance(text, str) else []


def merge(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that touch joined."""
    merged: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return merged


class Phrases:
    """The windows of benchmark items as word ids, grouped by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.ids: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.names = []
        for name, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if own:
                self.names.append(name)
                size = min(window, len(own))
                for k in range(len(own) - size + 1):
                    owners[tuple(own[k : k + size])].add(len(self.names) - 1)
        groups = defaultdict(list)
        for phrase, who in owners.items():
            groups[len(phrase)].append((phrase, sorted(who)))
        #: length: (phrases, first owner of each, owners), in arrays, as they travel with the tasks.
        self.by_length = {}
        for n, g in sorted(groups.items()):
            first = np.cumsum([0] + [len(w) for _, w in g])
            self.by_length[n] = (np.array([p for p, _ in g], np.int32), first, np.array([i for _, w in g for i in w], np.int32))
        self.shortest = min(self.by_length, default=1)

    def hits(self, index: FMIndex) -> Iterator[tuple[np.ndarray, int, dict[int, list[int]], np.ndarray]]:
        """(positions, length, items of each phrase, number of the phrase of each position)."""
        for length, (phrases, first, owner) in self.by_length.items():
            low, high = index.search(phrases.astype(np.int64))
            times = high - low
            if times.any():
                which = np.repeat(np.arange(len(phrases)), times)
                rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
                owners = {p: owner[first[p] : first[p + 1]].tolist() for p in np.unique(which).tolist()}
                yield index.locate(rows), length, owners, which


class Shard:
    """Documents whose known words wait for one index. Words that no phrase has, and runs of known words shorter than the
    shortest phrase, can be in no match, so only the other runs are indexed, each ended by 0."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.rows, self.text, self.origin, self.n = phrases, [], [], [], 0

    def add(self, key: object, text: str | None) -> None:
        known = self.phrases.ids
        words = words_of(text)
        ids = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.phrases.shortest:
                self.text += [ids[a:b], np.zeros(1, np.int64)]
                self.origin.append((self.n, len(self.rows), a))
                self.n += b - a + 1
        self.rows.append((key, len(words)))

    def found(self) -> list[tuple]:
        """(key, n_words, starts, ends, items) of the rows: n_words, merged spans [start, end) of hit words, and the items whose windows occur."""
        spans, items = defaultdict(list), defaultdict(set)
        if self.n:
            at, row, word = (np.array(x) for x in zip(*self.origin, strict=True))
            for places, length, owners, which in self.phrases.hits(FMIndex(np.concatenate(self.text))):
                run = np.searchsorted(at, places, side="right") - 1
                start = places - at[run] + word[run]
                for r, s, p in zip(row[run].tolist(), start.tolist(), which.tolist(), strict=True):
                    spans[r].append((s, s + length))
                    items[r].update(owners[p])
        out = []
        for k, (key, n) in enumerate(self.rows):
            merged = merge(spans[k]) if k in spans else []
            names = sorted({self.phrases.names[i] for i in items[k]}) if k in items else []
            out.append((key, n, [x[0] for x in merged], [x[1] for x in merged], names))
        return out


def _search(phrases: Phrases, shard_words: int, text_at: int, clean: bool):
    """Adds the columns FOUND, or with `clean` puts the text without its spans in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, kept = Shard(phrases), 0, []

        def emit() -> pa.RecordBatch:
            own = pa.concat_batches(kept)
            _, n_words, starts, ends, items = zip(*shard.found(), strict=True)
            if clean:
                hit = [k for k, x in enumerate(starts) if x]
                if hit:
                    texts = own.column(text_at).to_pylist()
                    for k in hit:
                        texts[k] = without_spans(texts[k], starts[k], ends[k])
                    own = own.set_column(text_at, own.schema.field(text_at), pa.array(texts, own.schema.field(text_at).type))
                return own
            new = [pa.array(x, t) for x, t in zip((n_words, starts, ends, items), TYPES, strict=True)]
            return pa.RecordBatch.from_arrays([*own.columns, *new], [*own.schema.names, *FOUND])

        for batch in batches:
            first = 0
            for k, text in enumerate(batch.column(text_at).to_pylist()):
                shard.add(k, text)
                held += len(text or "")
                if shard.n >= shard_words or held >= 16 * shard_words:
                    kept.append(batch.slice(first, k + 1 - first))
                    yield emit()
                    shard, held, kept, first = Shard(phrases), 0, [], k + 1
            if first < batch.num_rows:
                kept.append(batch.slice(first))
        if shard.rows:
            yield emit()

    return run


def without_spans(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """`text` without the words of the spans and what stands between them."""
    if not isinstance(text, str) or not len(starts):
        return text
    at = [m.span() for m in WORD.finditer(lower_ascii(text))]
    out, last = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def _pieces(window: int):
    """Items' words, joined by spaces, in pieces of a bounded size that share `window` - 1 words with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                cuts = range(0, max(1, len(words) - window + 1), PIECE_WORDS)
                parts = [" ".join(words[k : k + PIECE_WORDS + window - 1]) for k in cuts] if words else []
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(parts, pa.string())], ["name", "text"])

    return run


def _passes(benchmark: DataFrame, item_col: str, window: int, pass_bytes: int) -> tuple[int, Callable[[int], Phrases]]:
    """The number of passes, normally one, and what gives the phrases of one of them: a bounded block of the items' pieces."""
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col("text").cast("string").alias("text")).where("text is not null")
    pieces = materialise(items.mapInArrow(_pieces(window), "name string, text string"), "items")
    n = int(pieces.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] // pass_bytes) + 1
    block = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    return n, lambda k: Phrases([(r["name"], r["text"]) for r in pieces.where(block == k).collect()], window)


def _hits(docs: DataFrame, passes: int, phrases: Callable[[int], Phrases], shard_words: int, text_col: str, key: list[str]) -> DataFrame:
    """(*key, starts, ends, items) of the texts that any pass finds: each pass runs for itself, its phrases are gone when the
    next begins, and only the texts it finds are written. Equal texts count once."""
    texts = docs.select(*key, F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(texts.schema.fields + T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in FOUND.items())).fields)
    tables = []
    for k in range(passes):
        found = texts.mapInArrow(_search(phrases(k), shard_words, 2, False), schema).where(F.size("starts") > 0)
        tables.append(materialise(found.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("starts", "ends", "items")]), "hits"))
    every = reduce(DataFrame.union, tables)
    return every.groupBy(*key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])


def _merged():
    def work(texts: list, starts: list, ends: list, items: list) -> list[list]:
        spans = [merge(zip(a, b, strict=True)) if a is not None else [] for a, b in zip(starts, ends, strict=True)]
        return [[len(words_of(t)) for t in texts], [[x for x, _ in s] for s in spans], [[y for _, y in s] for s in spans], [sorted(set(i or ())) for i in items]]

    return work


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """All columns of `docs` with n_words, starts, ends and items: merged word spans that windows of the benchmark cover,
    and the benchmark items in question. Columns of these names are replaced.

    Words: A-Z lower-cased, then runs of characters as in WORD. A window is `window` consecutive words of an item; an item
    with fewer, but not none, is one window. Documents are read in shards of a bounded size inside each task; a shard is
    one FM-index. The phrases travel with the tasks. A benchmark of over `pass_bytes` is searched in passes, one after the
    other, each with a block of the items' pieces; what they find is written and joined at the end, so neither driver nor
    tasks hold more than one block.

    Null or empty texts have no words and no spans; null item texts have no windows; repeated rows are each answered;
    null ids stay null; texts of any length are read whole. Empty tables give no rows, or rows without spans.
    """
    passes, phrases = _passes(benchmark, item_col, window, pass_bytes)
    own = docs.drop(*FOUND)
    if passes == 1:
        schema = T.StructType(own.schema.fields + T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in FOUND.items())).fields)
        return own.mapInArrow(released(_search(phrases(0), shard_words, own.columns.index(text_col), False)), schema)
    a, b, *held = fresh(own, "text_a", "text_b", "held_starts", "held_ends", "held_items")
    keyed = own.withColumns({a: F.xxhash64(F.lit(11), text_col), b: F.xxhash64(F.lit(12), text_col)})
    hits = _hits(keyed, passes, phrases, shard_words, text_col, [a, b]).toDF(a, b, *held)
    both = keyed.join(hits, [a, b], "left").drop(a, b)
    return append_columns(both, FOUND, _merged, [text_col, *held], without=tuple(held))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """`docs` with the contaminated spans, as in `find_contamination`, cut from its texts; all rows and columns stay."""
    passes, phrases = _passes(benchmark, item_col, window, pass_bytes)
    if passes == 1:
        return docs.mapInArrow(released(_search(phrases(0), shard_words, docs.columns.index(text_col), True)), docs.schema)
    row = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = find_contamination(row, benchmark, window, shard_words, pass_bytes, item_col=item_col)

    def make():
        return lambda texts, starts, ends: [[without_spans(*x) for x in zip(texts, starts, ends, strict=True)]]

    clean = append_columns(found, {"clean": "string"}, make, ["text", "starts", "ends"], without=tuple(FOUND))
    return clean.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
