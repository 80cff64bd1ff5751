"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwell.llm.hot import join_hot
from shockwell.llm.scratch import discard, materialise

#: Edges contracted at once.
CHUNK = 500_000


def _to_minimum(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and all its partners. The minimum is combined before the shuffle, and
    pairs of a node with very many partners stay where they are."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(pairs, least, "u", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_minimum(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    own = _to_minimum(down, total)
    return own.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but the roots of the graph of these edges; the root is the smallest node of its group."""
    nodes, both = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges in stars, contracted CHUNK edges at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            u, v = stars(*(np.concatenate([b[c].to_numpy(np.int64) for b in held]) for c in ("u", "v")))
            held = []
            yield pd.DataFrame({"u": u, "v": v})
    if held:
        u, v = stars(*(np.concatenate([b[c].to_numpy(np.int64) for b in held]) for c in ("u", "v")))
        yield pd.DataFrame({"u": u, "v": v})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Self loops and repeated edges are harmless; edges with a null end are ignored; no edges give no rows.
    The edges of a task are first contracted to stars, CHUNK at a time, which leaves fewer edges and shorter paths.
    Each round is written to the shared folder, so lineage stays short and rounds survive lost executors.
    The number of rounds grows with the logarithm of a component's diameter; they end as soon as all components are stars.
    """
    usable = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    now = materialise(usable.mapInPandas(_contracted, "u long, v long").distinct(), "edges")
    total, open_ = _state(now)
    while open_:
        large = materialise(_large_star(now, total), "edges")
        after = materialise(_small_star(large, total), "edges")
        discard(now)
        discard(large)
        now = after
        total, open_ = _state(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes with a smaller neighbour that have another neighbour too: none if all components
    are stars around their smallest node, which a further round would leave as they are."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.count("*").alias("n"))
    total, open_ = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()
    return total or 0, open_
