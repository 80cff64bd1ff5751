"""Embedding near-duplicates: NN-descent refines a neighbour graph, and its edges over a threshold make groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.llm.components import connected_components
from shockwell.llm.hot import join_hot
from shockwell.llm.scratch import discard, materialise

#: Neighbours a list holds at first and at most; a saturated list doubles. Vectors in one local join; random orders at the start.
FIRST_LIST, LARGEST_LIST, JOIN_SIZE, ORDERS = 6, 24, 32, 6
#: Numbers in one comparison of runs.
COMPARED = 1 << 20
#: Vectors in a block of the exact comparison inside groups; vectors of the audit.
BLOCK, AUDITED = 1024, 256
#: Rounds at most, the share of changed neighbours that ends them, and the audit's recall below which they go on.
ROUNDS, SETTLED, WANTED = 4, 0.02, 0.99


@dataclass(frozen=True)
class Audit:
    """Links of a bounded sample of vectors, by brute force against all vectors of their label, and how many were found."""

    queries: int
    links: int
    found: int

    @property
    def recall(self) -> float:
        return self.found / self.links if self.links else 1.0


def _by_group(key: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]):
    """Calls `work` with each run of rows that share `key`; rows come sorted by it, and runs are small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([*held, batch], ignore_index=True) if held else batch.reset_index(drop=True)
            values = [rows[c].to_numpy() for c in key]
            new = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([v[1:] != v[:-1] for v in values]))))
            done = [x for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True) if (x := work(rows.iloc[a:b])) is not None]
            held = [rows.iloc[new[-1] :]]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held and (out := work(held[0])) is not None:
            yield out

    return run


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compared(vectors: np.ndarray, node: np.ndarray, bar: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> pd.DataFrame | None:
    """(node, other, cosine): in each run of rows start .. start + size every row's largest cosines with the others over its
    bar, at most `most`. Runs of one size are compared together; vectors in a run have one length."""
    out = []
    length = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for d in np.unique(length[start]) if len(start) else ():
        rows = np.flatnonzero(length == d)
        x = np.empty((len(vectors), d))
        x[rows] = unit(vectors[rows])
        own = length[start] == d
        for m in np.unique(size[own & (size > 1)]).tolist():
            first = start[own & (size == m)]
            step = max(1, COMPARED // (m * (m + int(d))))
            for k in range(0, len(first), step):
                at = first[k : k + step, None] + np.arange(m)
                part = x[at]
                cosine = part @ part.transpose(0, 2, 1)
                alone = node[at][:, :, None] == node[at][:, None, :]
                cosine[alone] = -2.0
                best = np.argpartition(-cosine, most - 1, axis=2)[:, :, :most] if m > most else np.broadcast_to(np.arange(m), cosine.shape)
                value = np.take_along_axis(cosine, best, axis=2)
                g, i, j = np.nonzero((value > bar[at][:, :, None]) & (value > -2.0))
                out.append((node[at[g, i]], node[at[g, best[g, i, j]]], value[g, i, j]))
    if not out:
        return None
    found = pd.DataFrame(dict(zip(("node", "other", "cosine"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
    return found


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Local joins: rows come sorted by at and deal, and those that share both meet."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        at, deal = rows["at"].to_numpy(), rows["deal"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (deal[1:] != deal[:-1]))))
        held = rows.iloc[start[-1] :]
        found = _compared(rows["vec"].to_numpy(), rows["node"].to_numpy(), rows["bar"].to_numpy(), start[:-1], np.diff(start), LARGEST_LIST)
        if found is not None:
            yield found
    if held is not None:
        found = _compared(held["vec"].to_numpy(), held["node"].to_numpy(), held["bar"].to_numpy(), np.zeros(1, np.int64), np.array([len(held)]), LARGEST_LIST)
        if found is not None:
            yield found


def _orders(seed: int, orders: int):
    """A row for each vector and order: the signs of its products with random directions, the first one highest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            for size, part in batch.groupby(batch["vec"].map(len)):
                x = unit(part["vec"].to_numpy())
                for k in range(orders):
                    plane = np.random.Generator(np.random.PCG64([seed, k, int(size)])).standard_normal((int(size), 62))
                    signs = (x @ plane > 0) @ (np.int64(1) << np.arange(62, dtype=np.int64)[::-1])
                    yield pd.DataFrame({"label": part["label"], "turn": k, "signs": signs, "node": part["node"], "vec": part["vec"]})

    return run


def _neighbours_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by label, order and signs: runs of JOIN_SIZE are compared, each overlapping half of the last."""
    held, half = None, JOIN_SIZE // 2
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        vectors, label, turn = (rows[c].to_numpy() for c in ("vec", "label", "turn"))
        length = np.fromiter(map(len, vectors), np.int64, len(vectors))
        edge = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (turn[1:] != turn[:-1]) | (length[1:] != length[:-1]), [True])))
        start = np.concatenate([np.arange(a, max(a + 1, b - half), half) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
        end = edge[np.searchsorted(edge, start, side="right")]
        held = rows.iloc[-half:]
        found = _compared(vectors, rows["node"].to_numpy(), np.full(len(rows), -2.0), start, np.minimum(end - start, JOIN_SIZE), FIRST_LIST)
        if found is not None:
            yield found


def _lists(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each node's largest cosines, as many as its list holds."""
    one = edges.groupBy("node", "other").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other"))
    return one.withColumn("rank", rank).where(F.col("rank") <= LARGEST_LIST).join(sizes, "node").where("rank <= size").select("node", "other", "cosine")


def _states(graph: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(node, size, bar): the list size from now on, doubled where a full list has reached the threshold to its end, and
    the cosine a newcomer must exceed."""
    ends = graph.groupBy("node").agg(F.count("*").alias("n"), F.min("cosine").alias("last"))
    both = sizes.join(ends, "node", "left")
    full = F.coalesce(F.col("n") >= F.col("size"), F.lit(False))
    larger = full & (F.col("last") >= threshold) & (F.col("size") < LARGEST_LIST)
    return both.select("node", F.when(larger, F.col("size") * 2).otherwise(F.col("size")).alias("size"), F.when(full & ~larger, F.col("last")).otherwise(-2.0).alias("bar"))


def _descend(graph: DataFrame, nodes: DataFrame, states: DataFrame, turn: int, parts: int) -> DataFrame:
    """Newcomers from a local join: at every node its neighbours, and those whose neighbour it is, meet each other and the
    node itself. A node with many of them holds several joins, dealt anew each round."""
    both = graph.select(F.col("node").alias("at"), F.col("other").alias("node")).union(graph.select(F.col("other").alias("at"), "node")).distinct()
    counts = both.groupBy("at").agg(F.ceil(F.count("*") / JOIN_SIZE).cast("int").alias("joins"))
    dealt = both.join(counts, "at").select("at", "node", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("joins")).cast("int").alias("deal"))
    own = counts.select("at", F.col("at").alias("node"), F.explode(F.sequence(F.lit(0), F.col("joins") - 1)).alias("deal"))
    known = nodes.select("node", "vec").join(states, "node")
    meeting = dealt.union(own).join(known, "node").select("at", "deal", "node", "bar", "vec")
    return meeting.repartition(parts, "at", "deal").sortWithinPartitions("at", "deal").mapInPandas(_meetings, "node long, other long, cosine double")


def _count_links(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        left, right = rows[rows["side"] != 1], rows[rows["side"] != 0]
        if not len(left) or not len(right):
            return None
        same = bool((rows["side"] == 2).all())
        near = unit(left["vec"].to_numpy()) @ unit(right["vec"].to_numpy()).T >= threshold
        if same:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": left["node"].to_numpy(), "links": near @ left["copies"].to_numpy(), "nodes": near.sum(axis=1)})
        return pd.concat(
            [
                pd.DataFrame({"node": left["node"].to_numpy(), "links": near @ right["copies"].to_numpy(), "nodes": near.sum(axis=1)}),
                pd.DataFrame({"node": right["node"].to_numpy(), "links": left["copies"].to_numpy() @ near, "nodes": near.sum(axis=0)}),
            ]
        )

    return work


def count_links(members: DataFrame, threshold: float, block: int, parts: int) -> DataFrame:
    """(node, links, nodes): for each of `members` (component, node, vec, copies) the vectors, copies included, and the
    different ones that it links with in its component. Components are compared in pairs of blocks; no pair is put out."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = pairs.select(
        "component", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"),
        F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1).alias("side"), "node", "vec", "copies",
    )
    key = ["component", "low", "high"]
    found = dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInPandas(_by_group(key, _count_links(threshold)), "node long, links long, nodes long")
    return found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("nodes").alias("nodes"))


def _paired(rows: DataFrame, by: str, block: int) -> DataFrame:
    """`rows` of (by, key, ...) once for each pair of blocks of `by` that they belong to, with low, high and side (0, 1; 2:
    the block itself)."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = rows.join(sizes, by).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    return own.withColumns({"low": F.least("own", "with"), "high": F.greatest("own", "with"), "side": side}).drop("blocks", "own", "with")


def _ball(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's centre, and the largest angle from it."""
    x = unit(rows["vec"].to_numpy())
    centre = x.sum(axis=0)
    norm = np.linalg.norm(centre)
    centre = centre / norm if norm > 1e-9 else x[0]
    angle = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    return pd.DataFrame({"place": [rows["place"].iloc[0]], "key": [rows["key"].iloc[0]], "component": [rows["component"].iloc[0]], "vec": [centre], "angle": [angle]})


def _near_balls(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        """Pairs of blocks, of different components, that may hold a link: centres within the link's angle and both radii."""
        left, right = rows[rows["side"] != 1], rows[rows["side"] != 0]
        if not len(left) or not len(right):
            return None
        angle = np.arccos(np.clip(unit(left["vec"].to_numpy()) @ unit(right["vec"].to_numpy()).T, -1, 1))
        near = angle <= np.arccos(threshold) + left["angle"].to_numpy()[:, None] + right["angle"].to_numpy()[None, :] + 1e-6
        a, b = np.nonzero(near & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]))
        a, b = left["key"].to_numpy()[a], right["key"].to_numpy()[b]
        once = (a < b) | (rows["side"] != 2).any()
        return pd.DataFrame({"a": a[once], "b": b[once]}) if once.any() else None

    return work


def _first_link(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(left) or not len(right):
            return None
        near = unit(left["vec"].to_numpy()) @ unit(right["vec"].to_numpy()).T >= threshold
        i, j = np.unravel_index(np.argmax(near), near.shape)
        return pd.DataFrame({"node": [left["node"].iloc[i]], "other": [right["node"].iloc[j]]}) if near[i, j] else None

    return work


def cross_links(members: DataFrame, threshold: float, block: int, parts: int) -> DataFrame:
    """(node, other): a link for each two blocks of `members` (component, node, label, vec) that have one, from different
    components of a label, by exact comparison. Blocks hold members of one component; those too far apart, by the angle
    between their centres and by their radii, aren't compared."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    key = F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = materialise(members.join(sizes, "component").select(F.xxhash64("label", F.size("vec")).alias("place"), key.alias("key"), "component", "node", "vec"), "dense")
    balls = rows.repartition(parts, "place", "key").sortWithinPartitions("place", "key").mapInPandas(_by_group(["place", "key"], _ball), "place long, key long, component long, vec array<double>, angle double")
    at = ["place", "low", "high"]
    near = _paired(materialise(balls, "balls"), "place", block).repartition(parts, *at).sortWithinPartitions(*at)
    pairs = materialise(near.mapInPandas(_by_group(at, _near_balls(threshold)), "a long, b long"), "pairs")
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("key")), F.struct(F.lit(1).alias("side"), F.col("b").alias("key")))).alias("s")).select("a", "b", "s.side", "s.key")
    both = sides.join(rows.select("key", "node", "vec"), "key").repartition(parts, "a", "b").sortWithinPartitions("a", "b")
    return materialise(both.mapInPandas(_by_group(["a", "b"], _first_link(threshold)), "node long, other long"), "cross")


def audit_recall(nodes: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDITED) -> Audit:
    """At most `sample` nodes, in the order of a hash, compared with all nodes of their label; counts come back, no pairs."""
    rows = nodes.select("node", "label", "vec").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    if not rows:
        return Audit(0, 0, 0)
    asked: dict[tuple[int, int], list[tuple[int, list[float]]]] = {}
    for r in rows:
        asked.setdefault((r["label"], len(r["vec"])), []).append((r["node"], r["vec"]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby([batch["label"], batch["vec"].map(len)]):
                if key in asked:
                    ids = np.array([i for i, _ in asked[key]])
                    near = unit(np.array([v for _, v in asked[key]])) @ unit(part["vec"].to_numpy()).T >= threshold
                    near &= ids[:, None] != part["node"].to_numpy()[None, :]
                    yield pd.DataFrame({"node": ids, "n": near.sum(axis=1)})

    true = nodes.select("label", "node", "vec").mapInPandas(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    both = true.join(counts, "node", "left").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("nodes"), F.lit(0))).first()
    return Audit(len(rows), int(both[0]), int(both[1]))


def near_duplicate_groups(vectors: DataFrame, threshold: float = 0.93, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Audit]:
    """(id, n_links, component_id, kept) for each row, and the audit of the links found.

    Vectors are compared only inside equal labels, by cosine in double precision. Equal vectors are one node.

    1. Start: vectors stand in ORDERS random orders (signs of random projections), dealt by range; neighbours in an order
       are compared, and each node keeps its closest.
    2. NN-descent: in each round neighbours of neighbours meet in local joins of a bounded size, and lists keep the
       closest. A list that is full of links is saturated and doubles. Rounds end when few lists change.
    3. Edges of at least `threshold` make components. Inside a component all links are counted exactly, in blocks: lists
       are bounded, and this is the exact way for what they can't hold.
       A list that was ever saturated may have lost links, and a link is lost only if both its ends' lists were: so all such
       nodes of a label in different components are compared exactly first, in blocks that a bound on angles prunes.
    4. The audit compares a bounded sample with all vectors. Under WANTED further orders and rounds follow, twice at most;
       if they don't suffice, all nodes of a label are compared as those with saturated lists are.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows whose label or id is null, link
    with nothing: n_links 0, component_id the id itself. Vectors of different lengths don't link. Repeated ids are separate
    rows. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("name"), F.col(vector_col).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("name").isNotNull() & sound, F.lit(False))
    mark = F.struct(F.xxhash64(F.lit(1), "name", "vec").alias("a"), F.xxhash64(F.lit(2), "vec", "name").alias("b")).alias("mark")  # of 128 bits
    marked = materialise(rows.where(usable).select("id", mark), "marks")
    grouped = rows.where(usable).groupBy("name", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    nodes = materialise(grouped.select(mark, F.xxhash64("name").alias("label"), "vec", "copies", "first", F.monotonically_increasing_id().alias("node")), "vectors")
    sizes = nodes.select("node", F.lit(FIRST_LIST).alias("size"))

    def start(turn: int) -> DataFrame:
        dealt = nodes.select("label", "node", "vec").mapInPandas(_orders(seed + turn, ORDERS), "label long, turn int, signs long, node long, vec array<double>")
        order = ["label", "turn", "signs", "node"]
        return dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_neighbours_in_order, "node long, other long, cosine double")

    def compared(dense: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, Audit]:
        """The components once those with nodes of `dense` are compared with each other, their exact counts, and the audit."""
        own = nodes.join(dense, "node", "left_semi").join(groups, "node", "left").select(F.coalesce("component", "node").alias("component"), "node", "label", "vec")
        cross = cross_links(own, threshold, BLOCK, parts)
        if not cross.isEmpty():
            groups = materialise(connected_components(cross.union(groups.select("node", "component")), "node", "other"), "groups")
        members = groups.join(nodes, "node").select("component", "node", "vec", "copies")
        counts = materialise(count_links(members, threshold, BLOCK, parts).join(groups, "node"), "counts")
        return groups, counts, audit_recall(nodes, counts.select("node", "nodes"), threshold)

    graph, states, turn = None, None, 0
    for attempt in range(3):
        first = start(attempt * ORDERS)
        new = materialise(_lists(first if graph is None else first.union(graph), sizes), "graph")
        discard(graph)
        graph, total = new, None
        for _ in range(ROUNDS):
            turn += 1
            now = materialise(_states(graph, sizes, threshold), "lists")
            new = materialise(_lists(graph.union(_descend(graph, nodes, now, turn, parts)), now.select("node", "size")), "graph")
            total = new.count() if total is None else total
            changed = new.join(graph, ["node", "other"], "left_anti").count()
            discard(graph)
            discard(states)
            graph, states, sizes = new, now, now.select("node", "size")
            if changed <= SETTLED * max(total, 1):
                break
        edges = graph.where(F.col("cosine") >= threshold).select("node", "other")
        groups = materialise(connected_components(edges, "node", "other"), "groups")
        ends = graph.groupBy("node").agg(F.count("*").alias("n"), F.min("cosine").alias("last"))
        dense = ends.join(sizes, "node").where((F.col("size") > FIRST_LIST) | ((F.col("n") >= F.col("size")) & (F.col("last") >= threshold))).select("node")
        groups, counts, audit = compared(dense, groups)
        if audit.recall >= WANTED:
            break
    else:
        groups, counts, audit = compared(nodes.select("node"), groups)
        if audit.recall < WANTED:
            raise RuntimeError(f"recall {audit.recall:.3f} after an exact comparison")
    named = nodes.select("mark", "node", "copies", "first").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = materialise(named.join(least, "component").select("mark", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "whole")
    linked = join_hot(marked, whole, "mark", "copies", marked.count()).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), audit
