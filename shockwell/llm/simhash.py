"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through shared blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwell.llm.components import connected_components
from shockwell.llm.hot import join_hot
from shockwell.llm.scratch import materialise

#: Fingerprints that a bucket holds at most before it is split.
MOST_IN_BUCKET = 1 << 16


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of 64 bits."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _over_half(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set of hashes: a bit is 1 if over half of them have it; an empty set: 0."""
    step = 1 << 17
    return _over_half(sum((_ones(hashes[k : k + step]) for k in range(0, len(hashes), step)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if over half of the shingles' XXH64 (seed 42) have it; no words: 0."""
    words = text.encode().lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    step = 1 << 17
    for k in range(0, n, step):
        ones += _ones(np.array([digest(joined[i:j], 42) for i, j in zip(starts[k : k + step], ends[k : k + step], strict=True)], dtype="<u8"))
    return _over_half(ones, n)


def _fingerprints(words_per_shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(x, words_per_shingle) for x in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "fp": bits.view(np.int64)})

    return run


def block_masks(blocks: int, distance: int, bits: int = (1 << 64) - 1) -> list[int]:
    """Masks over the given bits. Two values that differ in at most `distance` of them agree under at least one: of
    `blocks` blocks, at most `distance` differ, so some choice of `blocks - distance` blocks is equal."""
    places = [k for k in range(64) if bits >> k & 1]
    if not distance < blocks <= len(places):
        raise ValueError("needs more blocks than differing bits, and at most one for each bit")
    edges = np.linspace(0, len(places), blocks + 1).round().astype(int).tolist()
    part = [sum(1 << k for k in places[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - distance)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket_edges(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that span the groups of `members` linked within `distance` bits: each member found is compared with those
    not found yet, so a dense bucket costs little more than its size."""
    rest, edges = members, []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                edges += [(int(at), int(x)) for x in found]
                front += list(found)
                rest = rest[~near]
    return edges


def _links(distance: int, most: int):
    def emit(fp: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
        key = fp & mask
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        a, b = fp[start[size == 2]], fp[start[size == 2] + 1]
        near = np.bitwise_count(a ^ b) <= distance
        edges = [np.stack([a[near], b[near]], axis=1)]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if found := _bucket_edges(fp[s : s + n], distance):
                edges.append(np.array(found, dtype=np.uint64))
        both = np.unique(np.concatenate(edges), axis=0).view(np.int64)
        return pd.DataFrame({"src": both[:, 0], "dst": both[:, 1], "mask": pd.Series([None] * len(both), dtype="Int64")})

    def left(fp: np.ndarray, mask: np.uint64) -> pd.DataFrame:
        return pd.DataFrame({"src": fp.view(np.int64), "dst": fp.view(np.int64), "mask": pd.Series(np.full(len(fp), mask).view(np.int64), dtype="Int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by mask and block; a bucket that goes on in the next batch is carried over. One that grows
        beyond `most` rows leaves as rows with its mask, which the caller splits further."""
        held, held_mask = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        full = None  # (mask, block) of a bucket that is leaving
        for batch in batches:
            fp, mask = (batch[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "mask"))
            if full is not None:
                own = (mask == full[0]) & ((fp & full[0]) == full[1])
                if own.any():
                    yield left(fp[own], full[0])
                fp, mask = fp[~own], mask[~own]
            fp, mask = np.concatenate([held, fp]), np.concatenate([held_mask, mask])
            if not len(fp):
                continue
            last = (mask == mask[-1]) & ((fp & mask[-1]) == (fp[-1] & mask[-1]))
            held, held_mask = fp[last], mask[last]
            if not last.all():
                yield emit(fp[~last], mask[~last])
            if len(held) > most:
                full = (held_mask[0], held[0] & held_mask[0])
                yield left(held, full[0])
                held, held_mask = held[:0], held_mask[:0]
        if len(held):
            yield emit(held, held_mask)

    return run


def _finer(distance: int, blocks: int):
    """Splits rows of large buckets: what differs lies outside the bucket's mask, and blocks of those bits are chosen anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mask, part in batch.groupby("mask"):
                held = int(mask) & (1 << 64) - 1
                for more in block_masks(blocks, distance, ~held & (1 << 64) - 1):
                    m = signed(held | more)
                    yield pd.DataFrame({"fp": part["fp"], "mask": m, "block": part["fp"] & m})

    return run


def fingerprint_links(nodes: DataFrame, distance: int, blocks: int, most: int = MOST_IN_BUCKET) -> DataFrame:
    """(src, dst): edges between different fingerprints of `nodes` that span every group linked within `distance` bits.

    Each fingerprint goes to one bucket per choice of blocks. A bucket of over `most` fingerprints is split by the same
    rule over the bits that its members needn't share; after two such rounds 12 bits are left, so no bucket is larger
    than 4096. Only sets of close fingerprints get there, and no pair is lost.
    """
    masks = F.array(*[F.lit(signed(m)) for m in block_masks(blocks, distance)])
    rows = nodes.select("fp", F.explode(masks).alias("mask")).withColumn("block", F.col("fp").bitwiseAND(F.col("mask")))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = []
    for rest in (most, most, 1 << 62):
        dealt = rows.repartition(parts, "mask", "block").sortWithinPartitions("mask", "block")
        found = materialise(dealt.mapInPandas(_links(distance, rest), "src long, dst long, mask long"), "links")
        out.append(found.where("mask is null").select("src", "dst"))
        large = found.where("mask is not null").select(F.col("src").alias("fp"), "mask")
        if large.isEmpty():
            break
        rows = large.mapInPandas(_finer(distance, blocks), "fp long, mask long, block long")
    return reduce(DataFrame.union, out)


def simhash_groups(docs: DataFrame, distance: int = 4, words_per_shingle: int = 4, blocks: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: fp is the fingerprint as a signed long, component_id the smallest id reachable
    over links of at most `distance` differing bits.

    Equal fingerprints are one node, so thousands of exact copies cost one row in the block join. Every pair within
    `distance` bits meets in at least one bucket, whatever `blocks` is. In a bucket Hamming distances are verified, and
    only edges that span its groups leave it, never all pairs. Shingle words are 4 here because the query's contract
    says so.

    Null or empty text has fingerprint 0 and links like any other; long texts are read whole. Null id: the row keeps its fingerprint and takes its
    group's smallest id. Repeated ids are separate rows. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = materialise(rows.mapInPandas(_fingerprints(words_per_shingle), "id long, fp long"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    groups = connected_components(fingerprint_links(nodes, distance, blocks))
    named = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "first", "copies", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = materialise(named.join(least, "component").select("fp", "copies", "component_id"), "whole")
    return join_hot(prints, whole, "fp", "copies", prints.count()).select(F.col("id").alias(id_col), "fp", "component_id")
