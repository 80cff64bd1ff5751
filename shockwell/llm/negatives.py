"""Hard-negative mining: for every anchor and positive, the first rows of a window of scores, by distributed radix selection.

All scores of all anchors fit no table, so none is made. Anchors in blocks meet all rows, streamed; a window's kth score is
found digit by digit: tasks count scores by bucket, the counts of all tasks are added, and the bucket that holds the kth
score is the next pass's range. A last pass gathers the rows at or over that score, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockwell.llm.batches import released
from shockwell.llm.scratch import discard, materialise

#: Anchors in a block; bits of a digit; scores held at once; entries that wait before counts are added up.
ANCHORS, DIGIT_BITS, SCORES, WAITING = 4096, 10, 1 << 20, 1 << 20
#: Scores must stay below this, so that the window's products fit 64 bits; below EXACT doubles add them up exactly.
LARGEST, EXACT = 1 << 56, 1 << 53
NOBODY = np.iinfo(np.int64).max

HISTOGRAM = "key long, w int, bucket long, n long"
TAKEN = "key long, w int, id long, score long"


def _usable(rows: DataFrame, is_anchor: Column, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(key, id, lab, vec, asks, norm) of the rows that take part; norm is at least that of the floored vector."""
    integral = isinstance(rows.schema[label_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    lab = F.col(label_col).cast("long") if integral else F.xxhash64(F.col(label_col))
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.col(vector_col).cast("array<double>")
    usable = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * scale * x * scale)) + F.sqrt(F.size(vec).cast("double"))
    return usable.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), lab.alias("lab"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), norm.alias("norm")
    )


class Block:
    """A block of anchors with their windows, and what was found for them in the rows so far."""

    def __init__(self, rows: list[dict], scale: float, same: bool, shift: int | None, most: int):
        self.scale, self.same, self.shift, self.most = scale, same, shift, most
        self.key, self.id, self.lab = (np.array([r[c] for r in rows], np.int64) for c in ("key", "id", "lab"))
        self.vec = [whole(r["vec"], scale) for r in rows]
        self.sizes = np.array([len(v) for v in self.vec])
        width = max(len(r["windows"]) for r in rows)
        self.low, self.high, self.need, self.w = np.full((len(rows), width), NOBODY), np.full((len(rows), width), -NOBODY), np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int32)
        for k, r in enumerate(rows):
            for j, x in enumerate(r["windows"]):
                self.low[k, j], self.high[k, j], self.need[k, j], self.w[k, j] = x["lo"], x["hi"], x["need"], x["w"]
        self.windows = width
        self.waiting, self.count = [], 0
        self.found: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(2 if shift is not None else 3))

    def add(self, ids: np.ndarray, labs: np.ndarray, vectors: list[np.ndarray]) -> None:
        """Rows meet the anchors of their vectors' length."""
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(self.sizes == size)
            if not len(own):
                continue
            theirs = np.flatnonzero(sizes == size)
            anchors = np.stack([self.vec[k] for k in own])
            step = max(1, SCORES // len(own))
            for at in (theirs[k : k + step] for k in range(0, len(theirs), step)):
                self._meet(own, anchors, ids[at], labs[at], np.stack([vectors[k] for k in at]))

    def _meet(self, own: np.ndarray, anchors: np.ndarray, ids: np.ndarray, labs: np.ndarray, rows: np.ndarray) -> None:
        score = inner(rows, anchors)
        low, high = self.low[own].min(axis=1), self.high[own].max(axis=1)
        alike = labs[:, None] == self.lab[own]
        row, anchor = np.nonzero((alike if self.same else ~alike) & (ids[:, None] != self.id[own]) & (score >= low) & (score <= high))
        score, anchor = score[row, anchor].astype(np.int64), own[anchor]
        for j in range(self.windows):
            inside = np.flatnonzero((score >= self.low[anchor, j]) & (score <= self.high[anchor, j]))
            window, s = anchor[inside] * self.windows + j, score[inside]
            if self.shift is None:
                self.waiting.append((window, -s, ids[row[inside]]))
            else:
                self.waiting.append((window, (self.high[anchor[inside], j] - s) >> self.shift))
            self.count += len(inside)
        if self.count > WAITING:
            self.settle()

    def settle(self) -> None:
        """Adds up what waits; what can't be among a window's first rows is let go, here and in the rows to come."""
        arrays = [np.concatenate([old, *(x[k] for x in self.waiting)]) for k, old in enumerate(self.found[:2] if self.shift is not None else self.found)]
        self.waiting, self.count = [], 0
        if self.shift is None:
            window, negative, ids = arrays
            order = np.lexsort((ids, negative, window))
            window, negative, ids = window[order], negative[order], ids[order]
            keep = place_in_run(window) < self.most
            self.found = (window[keep], negative[keep], ids[keep])
            return
        window, bucket = arrays
        times = np.concatenate((self.found[2] if len(self.found) == 3 else np.zeros(0, np.int64), np.ones(len(window) - len(self.found[0]), np.int64)))
        order = np.lexsort((bucket, window))
        window, bucket, times = window[order], bucket[order], times[order]
        new = np.concatenate(([True], (window[1:] != window[:-1]) | (bucket[1:] != bucket[:-1])))[: len(window)]
        first = np.flatnonzero(new)
        window, bucket, times = window[first], bucket[first], np.add.reduceat(times, first) if len(first) else times
        upto = np.cumsum(times)
        begin = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1]))[: len(window)])
        before = upto - times - np.repeat((upto - times)[begin], np.diff(np.append(begin, len(window))))
        need = self.need.ravel()[window]
        keep = before < need
        full = keep & (before + times >= need)
        at, j = np.divmod(window[full], self.windows)
        self.low[at, j] = np.maximum(self.low[at, j], self.high[at, j] - ((bucket[full] + 1) << self.shift) + 1)
        self.found = (window[keep], bucket[keep], times[keep])

    def result(self) -> list[pa.Array]:
        self.settle()
        at, j = np.divmod(self.found[0], self.windows)
        if self.shift is None:
            return [pa.array(self.key[at]), pa.array(self.w[at, j]), pa.array(self.found[2]), pa.array(-self.found[1])]
        return [pa.array(self.key[at]), pa.array(self.w[at, j]), pa.array(self.found[1]), pa.array(self.found[2])]


def place_in_run(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each of the sorted `values`."""
    index = np.arange(len(values))
    return index - np.maximum.accumulate(np.where(np.concatenate(([True], values[1:] != values[:-1]))[: len(values)], index, 0)) if len(values) else index


def whole(vector: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(np.asarray(vector, np.float64) * scale)


def inner(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers; OverflowError where one could reach LARGEST."""
    most = float(np.sqrt((rows * rows).sum(axis=1).max(initial=0)) * np.sqrt((anchors * anchors).sum(axis=1).max(initial=0))) * 1.001
    if not most < LARGEST:
        raise OverflowError(f"scores may reach {LARGEST}")
    return rows @ anchors.T if most < EXACT else rows.astype(np.int64) @ anchors.astype(np.int64).T


def _cells(scale: float, same: bool, shift: int | None, most: int, schema: str):
    """Rows come sorted by block, each block's anchors before its rows."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, anchors, current = None, [], None
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            cell, kind = column["block"].to_numpy(), column["kind"].to_numpy()
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if cell[a] != current:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays(block.result(), names)
                    block, anchors, current = None, [], cell[a]
                part = {c: x.slice(a, b - a) for c, x in column.items()}
                if kind[a] == 0:
                    anchors += pa.RecordBatch.from_arrays(list(part.values()), list(part)).to_pylist()
                    continue
                if block is None:
                    if not anchors:
                        continue
                    block, anchors = Block(anchors, scale, same, shift, most), []
                ends = part["vec"].offsets.to_numpy()
                values = whole(part["vec"].values.to_numpy(), scale)
                block.add(part["id"].to_numpy(), part["lab"].to_numpy(), [values[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        if block is not None:
            yield pa.RecordBatch.from_arrays(block.result(), names)

    return released(run)


class Selection:
    """The first rows of windows over scores: rows of an anchor's own label, or of others."""

    def __init__(self, items: DataFrame, anchors: DataFrame, scale: float, same: bool, most: int):
        self.items, self.anchors, self.scale, self.same, self.most = items, anchors, scale, same, most
        spark = items.sparkSession
        self.blocks = max(1, -(-anchors.count() // ANCHORS))
        self.strips = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // self.blocks))

    def _pass(self, windows: DataFrame, shift: int | None, schema: str) -> DataFrame:
        """Each block of anchors meets each strip of the rows in one task."""
        block = F.pmod(F.xxhash64("key"), F.lit(self.blocks)).cast("int")
        each = windows.groupBy("key").agg(F.collect_list(F.struct("w", "lo", "hi", "need")).alias("windows"))
        asked = self.anchors.join(each, "key").select("key", "id", "lab", "vec", "windows", block.alias("block"), F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(self.strips - 1))).alias("strip"))
        strip = F.pmod(F.xxhash64("key"), F.lit(self.strips)).cast("int")
        rows = self.items.select("key", "id", "lab", "vec", F.lit(None).cast(each.schema["windows"].dataType).alias("windows"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"), F.lit(1).alias("kind"), strip.alias("strip"))
        dealt = asked.unionByName(rows).repartitionById(self.blocks * self.strips, (F.col("block") * self.strips + F.col("strip")).cast("int"))
        return dealt.sortWithinPartitions("block", "kind").mapInArrow(_cells(self.scale, self.same, shift, self.most, schema), schema)

    def select(self, windows: DataFrame) -> DataFrame:
        """(key, w, id, score, rank) of the first rows by (score descending, id) of each window (key, w, lo, hi)."""
        widest = windows.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 1
        digits = max(1, -(-int(widest - 1).bit_length() // DIGIT_BITS))
        state = materialise(windows.withColumn("need", F.lit(self.most).cast("long")), "windows")
        settled = []
        for digit in reversed(range(digits)):
            shift = digit * DIGIT_BITS
            counts = self._pass(state, shift, HISTOGRAM).groupBy("key", "w", "bucket").agg(F.sum("n").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("key", "w").orderBy("bucket"))
            placed = counts.withColumn("upto", upto).join(state, ["key", "w"]).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            high = F.col("hi") - F.col("bucket") * (1 << shift)
            found = placed.select("key", "w", F.greatest("lo", high - (1 << shift) + 1).alias("low"), high.alias("high"), (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
            both = materialise(state.join(found, ["key", "w"], "left"), "windows")
            discard(state)
            settled.append(both)
            state = both.where("low is not null").select("key", "w", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("left").alias("need"))
        # a window with fewer rows than asked for takes all; the others take what is over the kth score, and of its ties the first
        last = state.select("key", "w", F.col("lo").alias("least"))
        ranges = windows.join(last, ["key", "w"], "left").select("key", "w", F.coalesce("least", "lo").alias("lo"), "hi", F.lit(self.most).cast("long").alias("need"))
        ranges = materialise(ranges, "ranges")
        taken = self._pass(ranges, None, TAKEN)
        order = F.row_number().over(Window.partitionBy("key", "w").orderBy(F.desc("score"), "id"))
        out = materialise(taken.withColumn("rank", order).where(F.col("rank") <= self.most), "selected")
        for table in (*settled, ranges):
            discard(table)
        return out


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row of which `is_anchor` holds.

    Components count as floor(scale * x); a score is an exact inner product. Rows come in the order of higher score, then
    smaller id. An anchor's positives are its first `positives` other rows of its label. For each, the first `negatives`
    rows of other labels with low_percent * positive_score <= 100 * score <= high_percent * positive_score are returned, so
    a positive score under zero has none.

    Anchors, in blocks of 4096, meet all rows in as many strips as fill the cluster; a task reads its strip as a stream and
    holds one block, its counts and at most a million scores. Only counts (of no more buckets than can hold the kth score)
    and the rows found leave it: memory and what is shuffled don't depend on how many rows tie or share a label.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. An empty vector's score is 0.
    Vectors of different lengths never meet. Each of several rows with one id counts as a row; rows with an anchor's own
    id are not its partners, and each of several anchors with one id gets its answer. Labels that aren't integers are told
    apart by 64-bit hashes. Scores of 2**56 or more are an OverflowError. Fewer rows than asked for: all. An empty table
    gives no rows; other columns are ignored.
    """
    if not 0 <= low_percent <= high_percent <= 100:
        raise ValueError("0 <= low_percent <= high_percent <= 100 must hold")
    items = materialise(_usable(rows, is_anchor, scale, id_col, vector_col, label_col), "items")
    longest = items.agg(F.max("norm")).first()[0] or 0.0
    if longest * longest * 1.001 >= LARGEST:
        raise OverflowError(f"scores may reach {LARGEST}")
    anchors = materialise(items.where("asks").select("key", "id", "lab", "vec", "norm"), "anchors")
    bound = (F.ceil(F.col("norm") * F.lit(longest * 1.001)) + 1).cast("long")
    near = Selection(items, anchors, scale, True, positives).select(anchors.select("key", F.lit(0).alias("w"), (-bound).alias("lo"), bound.alias("hi")))
    window = near.where("score >= 0").selectExpr("key", "rank AS w", f"(score * {low_percent} + 99) DIV 100 AS lo", f"score * {high_percent} DIV 100 AS hi")
    asked = materialise(window.where("lo <= hi"), "asked")
    found = Selection(items, anchors, scale, False, negatives).select(asked)
    positive = near.select("key", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    paired = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positive, ["key", "w"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    out = materialise(paired.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for table in (items, anchors, near, asked, found):
        discard(table)
    return out
