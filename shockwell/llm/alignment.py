"""Cross-tokenizer alignment: the smallest groups of two tokenizers' tokens that cover the same bytes, and how often ids meet.

A text's tokens of both kinds are the nodes of a bipartite graph, linked where their byte ranges overlap. Union-find gives
its components: the minimal groups. Pairs of linked ids are counted by document over the whole corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwell.llm.batches import released
from shockwell.llm.hot import join_hot
from shockwell.llm.scratch import discard, materialise
from shockwell.llm.tokens import MOST_IDS, Encoder, default_tokenizer
from shockwell.llm.words import Memory

#: Characters of text aligned at once; entries of pairs that wait before they are added up; pairs whose counts are broadcast at most.
CHUNK, WAITING, MOST_BROADCAST = 1 << 20, 1 << 21, 4_000_000
#: Words, and their bytes, that each of a worker's two encoders remembers at most.
MOST_WORDS, MOST_BYTES = 300_000, 4 << 20


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_symbols() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte: printable ones are themselves, the others follow 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceEncoder(Encoder):
    """Encodes texts that begin with a space, which the pieces' own prefix stands for, with a sentencepiece BPE model.

    No piece of such a model goes from one word over a space into the next (verified when it is loaded; if one does, all
    texts are encoded as a whole), so words are encoded once and remembered, as the parent class does.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.width = 2 if len(pieces) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.bytes = [self._bytes(k, p) for k, p in enumerate(pieces)]
        self.begins = np.array([b[:1] in (b" ", b"\n") for b in self.bytes])
        self.memory, self.most_ids = Memory(MOST_WORDS, MOST_BYTES), MOST_IDS
        self.forget()

    def _bytes(self, k: int, piece: str) -> bytes:
        if self.model.is_byte(k):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.model.is_control(k) or self.model.is_unknown(k) else piece.replace("▁", " ").encode()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        bare = [t[1:] if t[:1] == " " else None for t in texts]
        if None in bare:  # a word without a space: what the model's own prefix adds is taken off again
            return [self._word(t) if b is None else np.array(self.model.encode(b), self.dtype) for t, b in zip(texts, bare, strict=True)]
        return [np.array(x, self.dtype) for x in self.model.encode(bare, num_threads=1)] if texts else []

    def _word(self, text: str) -> np.ndarray:
        """Ids of a text that begins with a newline: what follows the id of the prefix, a space of its own."""
        return np.array(self.model.encode(text)[1:], self.dtype)

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Words of one text after another; a word that begins neither with a space nor a newline can't occur."""
        first = words[0][0] == "\n"
        ids = self._whole([(" " if first else "") + "".join(words)])[0]
        starts = np.flatnonzero(self.begins[ids])[int(first) :]
        if len(starts) != len(words):
            return self._whole(words)
        return [ids[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return super().encode(texts) if self.apart else [x.tobytes() for x in self._whole(texts)]


def token_bytes(encoder: Encoder) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file."""
    symbol = byte_symbols()
    out = [b""] * (max(encoder.tokenizer.get_vocab().values()) + 1)
    for word, k in encoder.tokenizer.get_vocab(with_added_tokens=False).items():
        out[k] = bytes(symbol[c] for c in word)
    return out


def union_find(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component in the graph of edges (a, b): roots take a smaller root across an edge,
    paths are compressed, and edges inside a component are let go, until none is left."""
    parent = np.arange(nodes)
    while len(a):
        parent[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            shorter = parent[parent]
            if np.array_equal(shorter, parent):
                break
            parent = shorter
        a, b = parent[a], parent[b]
        between = a != b
        a, b = a[between], b[between]
    return parent


def digits(most: int) -> np.ndarray:
    """A row for each number below `most`: its decimal digits as characters, at the right; zeros before them."""
    places = len(str(most - 1))
    left, out = np.arange(most), np.zeros((most, places), np.uint8)
    for k in reversed(range(places)):
        out[:, k] = np.where((left > 0) | (k == places - 1), 48 + left % 10, 0)
        left = left // 10
    return out


class Aligned:
    """Several texts' tokens, aligned: arrays over all of them, with the numbers of each text."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray):
        n = len(a)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64) for ids in (a, b))
        text_a, text_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        # Texts lie one after another and both tokenizers cover the same bytes, so each stretch between neighbouring ends is
        # the overlap of one A and one B token: a link. A tokens are the first nodes, so a component's smallest node is one.
        ends = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        component = union_find(len(self.a) + len(self.b), link_a, len(self.a) + link_b)
        leads = component[: len(self.a)] == np.arange(len(self.a))
        number = np.cumsum(leads) - 1
        self.group_a, self.group_b = number[component[: len(self.a)]], number[component[len(self.a) :]]
        self.text_a, self.text_b, self.text = text_a, text_b, text_a[link_a]
        self.n_groups, self.n_links = np.bincount(text_a[leads], minlength=n), np.bincount(self.text, minlength=n)
        self.link_a, self.link_b = self.a[link_a], self.b[link_b]

    def digests(self, decimal: np.ndarray) -> list[str]:
        """SHA-256 of each text's groups, written as a1,a2|b1;a3|b2,b3; empty for a text without tokens."""
        total = len(self.a) + len(self.b)
        if not total:
            return [""] * len(self.n_a)
        before_a = np.searchsorted(self.group_b, self.group_a, side="left")  # B tokens in earlier groups
        before_b = np.searchsorted(self.group_a, self.group_b, side="right")  # A tokens in the same and earlier groups
        at_a, at_b = np.arange(len(self.a)) + before_a, np.arange(len(self.b)) + before_b
        ids, marks = np.zeros(total, np.int64), np.zeros(total, np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        marks[at_a] = np.where(np.append(np.diff(self.group_a) != 0, True), ord("|"), ord(","))
        last = np.append(np.diff(self.group_b) != 0, True)
        ends_text = np.append(np.diff(self.text_b) != 0, True)
        marks[at_b] = np.where(ends_text, 0, np.where(last, ord(";"), ord(",")))
        text = np.column_stack((decimal[ids], marks))
        ends = np.cumsum(np.count_nonzero(text, axis=1))
        data = text[text > 0].tobytes()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def pairs(self, ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links): the different pairs (id A * ids_b + id B) of each text in order, and how many links each has."""
        bits = int(self.a.max(initial=0) * ids_b + ids_b).bit_length()
        key = np.sort((self.text << bits) | (self.link_a * ids_b + self.link_b))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        return key[first] >> bits, key[first] & ((1 << bits) - 1), np.diff(np.append(first, len(key)))

    def groups(self) -> list[list[tuple[list[int], list[int]]]]:
        """Each text's groups: their A ids and B ids."""
        out: list[list[tuple[list[int], list[int]]]] = [[] for _ in self.n_a]
        for ids, group, text, side in ((self.a, self.group_a, self.text_a, 0), (self.b, self.group_b, self.text_b, 1)):
            at = -1
            for i, g, t in zip(ids.tolist(), group.tolist(), text.tolist(), strict=True):
                if side == 0 and g != at:
                    out[t].append(([], []))
                at = g
                first = int(self.group_a[np.searchsorted(self.text_a, t)])
                out[t][g - first][side].append(i)
        return out


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.first, self.second = Encoder(path_a), PieceEncoder(path_b)
        self.first.memory = Memory(MOST_WORDS, MOST_BYTES)
        self.bytes_a, self.bytes_b = token_bytes(self.first), self.second.bytes
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.decimal = digits(max(len(self.size_a), len(self.size_b)))

    def ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both tokenizers' ids of each text; none for a text that is null or empty, or that one of them doesn't give back."""
        full = [" " + t if t else "" for t in texts]
        there = [k for k, t in enumerate(full) if t]
        a, b = ([np.zeros(0, e.dtype)] * len(full) for e in (self.first, self.second))
        own = [full[k] for k in there]
        for k, x, y in zip(there, self.first.encode(own), self.second.encode(own), strict=True):
            x, y, raw = np.frombuffer(x, self.first.dtype), np.frombuffer(y, self.second.dtype), full[k].encode()
            if b"".join(map(self.bytes_a.__getitem__, x.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, y.tolist())):
                a[k], b[k] = x, y
        return a, b

    def align(self, texts: list[str | None]) -> Aligned:
        return Aligned(*self.ids(texts), self.size_a, self.size_b)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


#: Columns kept of each row; the pairs of a row are kept as the first one and the steps to the next.
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
GROUPS = "array<struct<a:array<int>,b:array<int>>>"


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about CHUNK characters; a longer text is alone."""
    held, first, own = 0, 0, []
    for k, text in enumerate(texts):
        value = text.as_py()
        if own and held + len(value or "") > CHUNK:
            yield first, own
            held, first, own = 0, k, []
        own.append(value)
        held += len(value or "")
    if own:
        yield first, own


def _align(path_a: str, path_b: str, names: list[str], keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        ids_b = len(work.size_b)
        for batch in batches:
            for first, texts in _chunks(batch.column(2)):
                done = work.align(texts)
                text, pair, links = done.pairs(ids_b)
                begin = np.searchsorted(text, np.arange(len(texts) + 1))
                step = np.diff(pair, prepend=0)
                step[begin[:-1][begin[:-1] < begin[1:]]] = pair[begin[:-1][begin[:-1] < begin[1:]]]
                arrays = [batch.column(k).slice(first, len(texts)) for k in (0, 1)] + [pa.array(x) for x in (done.n_a, done.n_b, done.n_groups, done.n_links)]
                arrays += [pa.array(done.digests(work.decimal), pa.string()), *(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x)) for x in (step, links.astype(np.int32)))]
                if keep_groups:
                    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                    arrays.append(pa.array([[{"a": a, "b": b} for a, b in own] for own in done.groups()], kind))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return released(run)


def _pairs_of(steps: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' pairs, and where each row's begin (and the last one's end)."""
    begin = steps.offsets.to_numpy().astype(np.int64)
    flat = steps.values.to_numpy()[begin[0] : begin[-1]]
    begin = begin - begin[0]
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(flat)))
    return upto[1:] - np.repeat(upto[begin[:-1]], np.diff(begin)), begin


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of the task hold each pair; what waits is added up, and put out when there are many different pairs."""
    pairs, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def settle() -> tuple[np.ndarray, np.ndarray]:
        found, inverse = np.unique(np.concatenate([pairs, *waiting]), return_inverse=True)
        return found, np.bincount(inverse, np.concatenate([counts, np.ones(held)]), len(found)).astype(np.int64)

    for batch in batches:
        waiting.append(_pairs_of(batch.column(0))[0])
        held += len(waiting[-1])
        if held > WAITING:
            pairs, counts = settle()
            waiting, held = [], 0
            if len(pairs) > WAITING:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, counts = settle()
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])


def pair_counts(aligned: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best): the number of rows that hold each pair, and whether no pair of the same A id is held by more."""
    counts = materialise(aligned.select("steps").mapInArrow(released(_summed), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    first = F.expr(f"pair DIV {ids_b}")
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    out = materialise(counts.withColumn("a", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discard(counts)
    return out


def _looked_up(names: list[str], table):
    """n_best and count_sum of each row, from the broadcast (pairs in order, counts, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in batches:
            pair, begin = _pairs_of(batch.column("steps"))
            own = batch.column("links")
            links = own.values.to_numpy()[own.offsets[0].as_py() : own.offsets[-1].as_py()].astype(np.int64)
            at = np.searchsorted(known, pair)
            sums = [np.concatenate((np.zeros(1, np.int64), np.cumsum(x))) for x in (links * best[at], links * count[at])]
            found = {"n_best": sums[0], "count_sum": sums[1]}
            yield pa.RecordBatch.from_arrays([pa.array(found[c][begin[1:]] - found[c][begin[:-1]]) if c in found else batch.column(c) for c in names], names)

    return released(run)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair, begin = _pairs_of(batch.column(1))
        own = batch.column(2)
        links = own.values.to_numpy()[own.offsets[0].as_py() : own.offsets[-1].as_py()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(begin))), pa.array(pair), pa.array(links)], ["row", "pair", "links"])


def align_tokenizers(
    docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, keep_groups: bool = False, most_broadcast: int = MOST_BROADCAST, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs). `rows`: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) for each row of
    `docs`. `pairs`: (a, b, n, best), how many rows hold A id a linked with B id b, and whether none of a's pairs is in more.

    A is a byte-level BPE file of the tokenizers library, over a space and the text; B a sentencepiece model over the text,
    to which it adds the space. Special tokens' strings inside texts are plain text. Tokens are linked where their bytes
    overlap; the components of a text's links are its groups. n_best counts the links whose pair is one of its A id's best,
    count_sum adds up, over the links, the rows that hold their pair. groups_sha256 is the digest of the groups, written as
    a1,a2|b1;a3|b2,b3; `keep_groups` adds them as arrays.

    Texts are encoded once, and their pairs kept as arrays. A task adds its counts up before they are shuffled, so a pair
    that every text holds is a row or two of each task. Up to `most_broadcast` pairs (a checked number) go to where the rows
    are; with more, rows are joined by pair, the hot ones where they are, to the same result.

    Null or empty texts, and those that A or B doesn't give back byte for byte, have no tokens: zeros and an empty digest.
    Each of several rows with one id counts for itself; ids, null ones too, are only passed on. Texts are read whole; one
    over a million characters is aligned alone. An empty table gives no rows; other columns are ignored.
    """
    path_a, path_b = tokenizer or default_tokenizer(), pieces or default_pieces()
    ids_b = _pieces_in(path_b)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, steps array<long>, links array<int>" + (f", groups {GROUPS}" if keep_groups else "")
    names = ["row", "id", *COUNTS, "groups_sha256", "steps", "links", *(["groups"] if keep_groups else [])]
    aligned = materialise(rows.mapInArrow(_align(path_a, path_b, names, keep_groups), schema), "aligned", "zstd")
    pairs = pair_counts(aligned, ids_b)
    out = ["id", *COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]
    if pairs.count() <= most_broadcast:
        held = pairs.orderBy("pair").toArrow()
        table = docs.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "n", "best")))
        kinds = {"id": kind, "groups_sha256": "string", "groups": GROUPS}
        found = aligned.drop("row").mapInArrow(_looked_up(out, table), ", ".join(f"{c} {kinds.get(c, 'long')}" for c in out))
    else:
        each = materialise(aligned.select("row", "steps", "links").mapInArrow(released(_each), "row long, pair long, links int"), "each")
        met = join_hot(each, pairs.withColumn("count", F.col("n")), "pair", "n", each.count())
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
        found = aligned.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}).select(*out)
    return found.withColumnRenamed("id", id_col), pairs.selectExpr(f"CAST(pair DIV {ids_b} AS INT) AS a", f"CAST(pair % {ids_b} AS INT) AS b", "n", "best")


@lru_cache(maxsize=2)
def _pieces_in(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
