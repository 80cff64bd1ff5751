"""Near-duplicates by word shingles: SimHash fingerprints and, beyond their reach, MinHash bands find candidates; exact Jaccard
similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockwell.llm.batches import ARROW, released
from shockwell.llm.components import connected_components
from shockwell.llm.hot import join_hot
from shockwell.llm.neighbours import _by_group
from shockwell.llm.scratch import discard, materialise
from shockwell.llm.simhash import fingerprint_links, set_fingerprint

#: Differing bits of fingerprints that are candidates, and the blocks that they are cut into.
DISTANCE, CUTS = 4, 7
#: Minima in a band, and the bands of each turn: first and end, and whether sets meet only their bucket's first one. Each
#: turn finds components anew, in rounds of jobs, so turns are few.
ROWS, BANDS, TURNS = 5, 30, ((0, 2, True), (0, 4, False), (4, 30, False))
#: Sets, and bytes of shingles, in a block of a bucket; columns of a product.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 1 << 22, 2048
#: Bits of the map that keeps most sets without a partner from the shuffle.
MAP_BITS = 1 << 22


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted XXH64 of the different shingles; fewer words are one shingle, no words give none."""
    words = text.encode().lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j]) for i, j in zip(starts, ends[-n:].tolist(), strict=True)], dtype=np.uint64))


def band_keys(shingles: np.ndarray, seed: int) -> list[int]:
    """A signed hash for each band of ROWS minima."""
    if not len(shingles):
        return []
    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, (2, ROWS * BANDS), dtype=np.uint64)
    least = np.full(draw.shape[1], (1 << 64) - 1, np.uint64)
    for k in range(0, len(shingles), 512):
        mixed = (shingles[k : k + 512, None] ^ draw[0]) * (draw[1] | np.uint64(1))
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(-1, ROWS))]


#: Columns of a set.
SETS = {"id": "long", "mark": "long", "node": "long", "n": "long", "fp": "long", "bands": "array<long>", "shingles": "binary"}


def _sets(words_per_shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            sets = [shingle_set(x, words_per_shingle) for x in part.column(1).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            prints = np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)
            values = (node, [len(s) for s in sets], prints, [band_keys(s, seed) for s in sets], [s.tobytes() for s in sets])
            arrays = [part.column(0), part.column(2), *(pa.array(v, ARROW[t]) for v, t in zip(values, list(SETS.values())[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, list(SETS))

    return run


def _shared(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many shingles each of the first `left` sets shares with each of the others; with all, if there are no others."""
    n = len(sets)
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    place = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    owner, column = owner[keep], place[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rest = slice(left, n) if left < n else slice(0, n)
    out = np.zeros((left, n - left or n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((n, min(COLUMNS, width - start)), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        out += has[:left] @ has[rest].T
    return out


def _similar(similarity: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        """Edges between different components, named by their smallest nodes: once a set is compared, all that are like it
        have its component."""
        side = rows["side"].to_numpy()
        order = np.argsort(side == 1, kind="stable")
        left = int((side != 1).sum())
        if not left or (left == len(rows) and (side == 0).any()) or rows["component"].nunique() < 2:
            return None
        rows = rows.iloc[order]
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        known, size = rows["component"].to_numpy(), np.array([len(s) for s in sets])
        component = known.copy()
        shift = left if left < len(rows) else 0
        shared = _shared(sets, left)
        near = shared >= similarity * (size[:left, None] + size[None, shift:] - shared) - 1e-3
        src, dst = [], []
        for i in range(left):
            found = np.flatnonzero(near[i] & (component[shift:] != component[i])) + shift
            if len(found):
                others, first = np.unique(component[found], return_index=True)
                src += [known[i]] * len(first)
                dst += known[found[first]].tolist()
                component[np.isin(component, others)] = component[i]
        return pd.DataFrame({"src": src, "dst": dst}, dtype="int64") if src else None

    return work


def _perhaps(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """`sets` without most of those whose node isn't wanted: a broadcast map of MAP_BITS bits, whatever the tables' sizes."""
    place = F.pmod("node", F.lit(MAP_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(node, {MAP_BITS}) % 64 as int))")
    words = wanted.select(F.floor(place / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return sets.withColumn("word", F.floor(place / 64)).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _alike(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n): a bucket for each fingerprint's first set, with that set, the others of the same fingerprint, and
    the first ones of fingerprints linked to it within DISTANCE bits. Buckets of a single set are left out."""
    own = nodes.where("n > 0").select("fp", "node")
    prints = materialise(own.groupBy("fp").agg(F.min("node").alias("bucket"), F.count("*").alias("copies")), "prints")
    links = fingerprint_links(prints.select("fp"), DISTANCE, CUTS)
    first = prints.select("fp", "bucket")
    near = links.join(first.withColumnRenamed("fp", "src"), "src").join(first.select(F.col("fp").alias("dst"), F.col("bucket").alias("node")), "dst").select("bucket", "node")
    same = join_hot(own, prints.where("copies > 1"), "fp", "copies", nodes.count()).where("node != bucket").select("bucket", "node")
    pairs = near.union(same)
    out = materialise(pairs.union(pairs.select("bucket", F.col("bucket").alias("node")).distinct()).join(nodes.select("node", "n"), "node").select("bucket", "node", "n"), "alike")
    discard(prints)
    return out


def text_mark(id_col: str, text_col: str) -> Column:
    """A hash of id and text: tells apart the texts of one id."""
    return F.xxhash64(F.col(id_col).cast("long"), F.lit(0), F.col(text_col).cast("string"))


def shingle_groups(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, component_id, kept) for each row: component_id is the smallest id reachable over links of texts whose
    sets of word shingles have at least `similarity` of their union in common; mark is `text_mark`; kept is true for one
    text of each group's smallest id (with that text's repeated rows).

    Equal sets are one node. Their SimHash fingerprints are linked through shared blocks (`fingerprint_links`), and in the
    first turn each set meets those that its fingerprint links too. Texts at 0.8 differ in about ten of 64 bits, which is beyond
    what blocks can find, so turns over MinHash bands follow for what isn't joined by then. Thirty bands of five MinHash minima deal the sets into buckets: a pair at 0.8 meets in one
    with probability 1 - (1 - 0.8^5)^30 = 0.999993, one at 0.9 practically always; at a lower `similarity` more pairs
    are missed (0.7: 0.4 %). In a bucket the shared shingles of all pairs from different components are counted exactly,
    in blocks, and only edges that join components leave it. The bands are used in turns: in their first one sets meet only
    their bucket's first set, which joins most copies at a cost that follows their number; a bucket whose sets are
    one component by then is not looked at again, so groups of copies travel for the first few bands only, and buckets of a
    single set, the most by far, never do.

    Null or empty texts are alike. Null id: the row takes its group's smallest id, and is kept only in a group without
    any. Repeated ids are separate rows. Texts of any length are read whole. An empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_mark(id_col, text_col).alias("mark"))
    sets = materialise(rows.mapInArrow(released(_sets(words_per_shingle, seed)), ", ".join(f"{c} {t}" for c, t in SETS.items())), "shingles")
    nodes = materialise(sets.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    every = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    members = [F.count("*").alias("c"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"), F.sum(F.xxhash64(F.lit(2), "node").cast("decimal(38,0)")).alias("y")]
    often = every.groupBy("bucket").agg(*members, F.min("band").alias("band")).where("c > 1")
    once = often.groupBy("c", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("first")).select("first.bucket")  # buckets of the same sets are looked at once
    shared = materialise(every.join(once, "bucket", "left_semi"), "buckets")
    alike, groups = _alike(nodes), None
    linked = alike.withColumn("pivot", F.col("bucket"))
    banded = [(shared.where(F.col("band").between(begin, end - 1)).select("bucket", "node", "n", F.col("node").alias("pivot")), first_only) for begin, end, first_only in TURNS]
    together = bool(TURNS) and TURNS[0][2]
    turns = [(linked.union(banded[0][0]) if together else linked, True), *banded[together:]]
    for keys, first_only in turns:
        keys = keys.withColumn("component", F.col("node")) if groups is None else keys.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = keys.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("pivot").alias("pivot"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")).where("low != high")
        met = materialise(keys.drop("pivot").join(open_.select("bucket", "blocks", "pivot"), "bucket").select("bucket", "blocks", "pivot", "node", "component"), "met")
        if met.isEmpty():
            continue
        every_block = F.sequence(F.lit(0), F.col("blocks") - 1)
        own = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.when(F.lit(not first_only) | (F.col("node") == F.col("pivot")), every_block).otherwise(F.array("own"))))
        if first_only:
            own = own.select("bucket", F.col("with").alias("low"), F.lit(0).alias("high"), (F.col("node") != F.col("pivot")).cast("int").alias("side"), "node", "component")
        dealt = own if first_only else own.select("bucket", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1).alias("side"), "node", "component")
        wanted = met.select("node").distinct()
        texts = _perhaps(sets.select("node", "shingles"), wanted).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
        key = ["bucket", "low", "high"]
        pairs = dealt.join(texts, "node").repartition(parts, *key).sortWithinPartitions(*key)
        edges = materialise(pairs.mapInPandas(released(_by_group(key, _similar(similarity))), "src long, dst long"), "similar")
        discard(met)
        known = edges if groups is None else edges.union(groups.select("node", "component"))
        new = materialise(connected_components(known), "groups")
        discard(groups)
        groups = new
    named = nodes.withColumn("component", F.col("node")) if groups is None else nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("keeper"))
    whole = materialise(named.join(least, "component").select("node", "copies", "keeper"), "named")
    found = join_hot(sets.select("id", "mark", "node"), whole, "node", "copies", sets.count())
    kept = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("mark") == F.col("keeper.mark"))
    out = materialise(found.select(F.col("id").alias(id_col), "mark", F.col("keeper.id").alias("component_id"), kept.alias("kept")), "near")
    for table in (sets, nodes, shared, alike, whole, groups):
        discard(table)
    return out
