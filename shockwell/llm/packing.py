"""Packing: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.llm.batches import ARROW, ROWS, local_table, released
from shockwell.llm.scratch import materialise
from shockwell.llm.tokens import MOST_WORDS, default_tokenizer, encoder


def shortest_pack_first(histogram: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) packing patterns that place every piece of the histogram into packs of at most `room`.

    Lengths are placed longest first. A pack is chosen by how full it is: of the packs in which the length fits, the
    least full is taken (the shortest pack). Counts are updated for whole patterns, so the work follows the number of
    different lengths, not of pieces.
    """
    by_left: dict[int, list[list]] = defaultdict(list)  # room left: [[times, lengths], ...]
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            left = max((k for k, v in by_left.items() if v and k >= length), default=None)
            if left is None:
                by_left[room - length].append([count, (length,)])
                break
            pattern = by_left[left].pop()
            take = min(count, pattern[0])
            if pattern[0] > take:
                by_left[left].append([pattern[0] - take, pattern[1]])
            by_left[left - length].append([take, (*pattern[1], length)])
            count -= take
    return [(times, lengths) for packs in by_left.values() for times, lengths in packs]


#: Columns of a piece.
PIECE = {"id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "ids": "binary"}


def _pieces(path: str, end_id: int, room: int, names: list[str], most_words: int, keep_words: bool):
    types = [ARROW[PIECE[c]] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, most_words)
        end = np.array([end_id], "<u4")
        for part in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows = []
            for i, raw in zip(part.column(0).to_pylist(), code.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                ids = np.concatenate([np.frombuffer(raw, code.dtype).astype("<u4"), end])
                for start in range(0, len(ids), room):
                    own = ids[start : start + room].tobytes()
                    rows.append((i, start, len(own) // 4, zlib.crc32(own), len(ids), own)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if not keep_words:
            encoder.cache_clear()

    return run


def pack_documents(docs: DataFrame, room: int = 2048, end_id: int = 1, tokenizer: str | None = None, keep_ids: bool = False, most_words: int = MOST_WORDS, keep_words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Whole texts are encoded and end with `end_id`. Documents longer than `room` are cut at its multiples. The histogram
    of lengths, at most `room` entries, goes to the driver and gives packing patterns; pieces take their places by
    their rank among pieces of the same length. Ranks are made in hash buckets with sums of the buckets before, so the
    commonest length (full pieces) is no single task. `keep_ids` adds little-endian 32-bit ids. A worker remembers the ids of
    `most_words` words at most, for its next task too if `keep_words`; else the tokenizer goes with them.

    Null or empty text: one piece, the end id alone. Null and repeated ids: each row is packed for itself. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = list(PIECE)[: len(PIECE) - (not keep_ids)]
    pieces = materialise(rows.mapInArrow(released(_pieces(path, end_id, room, names, most_words, keep_words)), ", ".join(f"{c} {PIECE[c]}" for c in names)), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, used, first = [], defaultdict(int), 0
    for times, lengths in shortest_pack_first(counts, room):
        offset = 0
        for length in lengths:
            places.append((length, used[length], used[length] + times, first, offset))
            used[length] += times
            offset += length
        first += times
    spots = local_table(spark, "length long, low long, high long, first_sequence long, offset long", places)
    buckets = max(1, -(-sum(counts.values()) // 100_000))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32")
    ranked = dealt.withColumn("at", F.row_number().over(inside) - 1).join(ahead, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("at"))
    placed = ranked.alias("p").join(
        spots.alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    return placed.select(
        F.col("id").alias(id_col), "start", F.col("p.length"), "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *(["ids"] if keep_ids else []),
    )
