"""Sharding: a uniform shuffle with exact shard sizes, drawn through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.llm.batches import local_table

#: Rows of a source partition that the local permutation sorts at once; lines of the matrix, which is the driver's share of
#: the work: with more rows than both allow, source partitions hold more rows each and their sorts spill.
ROWS_PER_PARTITION, MOST_LINES = 4096, 1 << 17
#: From this population on numpy's hypergeometric draws are refused.
NUMPY_LIMIT = 10**9


def _stirling_error(n: float) -> float:
    """ln n! minus Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    s = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - s / 1680) * s) * s) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without cancellation near x = mean."""
    d = (x - mean) / (x + mean)
    if abs(d) >= 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, k = (x - mean) * d, 2 * x * d, 1
    while True:
        term *= d * d
        k += 2
        new = total + term / k
        if new == total:
            return total
        total = new


def _log_binomial(x: int, n: int, p: float) -> float:
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    tails = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return tails - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) - 0.5 * math.log(2 * math.pi * x * (n - x) / n)


def _large_hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of `n` drawn without replacement are good, for populations of any size: rejection under an envelope that
    holds for every log-concave law with a known mode. Probabilities come as quotients of binomial ones, which stay exact
    to a few units in the last place where factorials would cancel."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    p = n / total

    def log_weight(x: int) -> float:
        return _log_binomial(x, good, p) + _log_binomial(n - x, bad, p)

    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    top = log_weight(mode)
    peak = math.exp(top - _log_binomial(n, total, p))
    width = 1 + peak / 2
    while True:
        u, v, w, sign = draw.random(4).tolist()
        y = v * width / peak if u <= width / (1 + width) else (width - math.log(max(v, 1e-300))) / peak
        x = mode + (1 if sign < 0.5 else -1) * round(y)
        if low <= x <= high and math.log(max(w, 1e-300)) + min(0.0, width - peak * y) <= log_weight(x) - top:
            return x


def hypergeometric(draw: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A draw for each triple."""
    out = np.zeros(len(good), np.int64)
    small = good + bad < NUMPY_LIMIT
    out[small] = draw.hypergeometric(good[small], bad[small], n[small])
    for k in np.flatnonzero(~small).tolist():
        out[k] = _large_hypergeometric(draw, int(good[k]), int(bad[k]), int(n[k]))
    return out


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[p, s]: how many of partition p's rows go to shard s, as a uniform shuffle of all rows would have it.

    Column sums are exact: the rows over all shards, at most one apart. Partitions are halved again and again: what a
    half sends to each shard is a multivariate hypergeometric draw from what the whole sends there. All halves of a level
    are drawn together, so only the few largest have populations beyond numpy's.
    """
    total = sum(rows)
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    draw = np.random.Generator(np.random.PCG64(seed))
    size = np.zeros(1 << max(0, (len(rows) - 1).bit_length()), np.int64)
    size[: len(rows)] = rows
    now = room[None, :]
    while len(now) < len(size):
        want = size.reshape(2 * len(now), -1).sum(axis=1)[::2]
        left, rest = np.zeros_like(now), now.sum(axis=1)
        for s in range(shards):
            rest = rest - now[:, s]
            left[:, s] = hypergeometric(draw, now[:, s], rest, want)
            want = want - left[:, s]
        now = np.stack((left, now - left), axis=1).reshape(-1, shards)
    return now[: len(rows)]


def _hashable(df: DataFrame, column: str) -> Column:
    """The column, as JSON if it holds maps, which Spark doesn't hash."""
    own = F.col(f"`{column}`")
    return F.to_json(F.struct(own)) if "map<" in df.schema[column].dataType.simpleString() else own


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 20, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """All columns of `docs` with shard (0 to `shards` - 1) and slot (gapless from 0 in a shard, the shuffled order).

    1. Rows are dealt to source partitions by a hash of all their values, so a retry or another job deals them alike.
    2. The driver gets one count per partition and draws the communication matrix, of at most MOST_LINES lines; a matrix
       of fewer lines than partitions of `rows_per_partition` need is as exact, but its partitions' sorts are longer.
    3. In each partition rows are ranked by a seeded hash, and the first counts[p, 0] go to shard 0, the next to shard 1 ...
    4. In a shard rows are ranked again by another seeded hash: hash buckets, sized like source partitions, are ranked
       side by side, and the sums of the buckets before them make the ranks gapless.

    Rows move twice and no task holds more than a partition or a bucket. Shard sizes are at most one apart whatever the
    data: equal texts are not kept together, as a group can be larger than a shard. Rows equal in every column are
    interchangeable and meet in one source partition. Nulls hash like values, long texts like short ones, columns that
    hold maps as JSON; an empty table gives no rows. Columns named shard or slot are replaced.
    """
    spark = docs.sparkSession
    if shards < 1:
        raise ValueError("shards must be positive")
    own = docs.drop("shard", "slot")
    rows = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("_row"), F.xxhash64(F.lit(seed), *[_hashable(own, c) for c in own.columns]).alias("_key"))
    total = docs.count()
    partitions = int(min(MOST_LINES, max(32, -(-total // rows_per_partition))))
    buckets = int(max(4, -(-total // (shards * rows_per_partition))))
    keyed = rows.withColumn("_p", F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(partitions)).cast("int"))
    found = {r["_p"]: r["n"] for r in keyed.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([found.get(p, 0) for p in range(partitions)], shards, seed)
    ends = local_table(spark, "_p int, _ends array<long>", list(enumerate(matrix.cumsum(axis=1).tolist())))
    local = Window.partitionBy("_p").orderBy(F.xxhash64("_key", F.lit(2)), "_key")
    dealt = (
        keyed.withColumn("_rank", F.row_number().over(local) - 1)
        .join(ends, "_p")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
        .withColumn("_turn", F.xxhash64("_key", "_rank", "_p", F.lit(3)))
        .withColumn("_bucket", F.pmod("_turn", F.lit(buckets)).cast("int"))
        .drop("_rank", "_ends", "_p")
    )
    sizes = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_turn", "_key")
    ranked = dealt.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, ["shard", "_bucket"])
    return ranked.withColumn("slot", (F.col("_before") + F.col("_at")).cast("long")).select("_row.*", "shard", "slot")
