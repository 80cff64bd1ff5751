"""Joins whose keys may be hot: a key that a large part of all rows holds doesn't land in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most; a key is hot if more than a MOST_HOT-th of the rows, and at least LEAST_HOT, hold it.
MOST_HOT, LEAST_HOT = 4000, 1000


def join_hot(many: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """`many` with the columns of `one` (but `n`) for each row whose `key` it holds.

    `one` has one row for each key, and in `n` how many rows of `many` hold that key, at most; `total` is their number.
    Fewer than MOST_HOT keys can be hot, so those are broadcast, whatever the tables' sizes; the others are shuffled.
    Both halves read `many`, which should be a written table.
    """
    least = max(LEAST_HOT, total // MOST_HOT)
    hot = one.where(F.col(n) > least).drop(n)
    found = many.join(F.broadcast(hot), key)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col(n) <= least).drop(n), key)
    return found.unionByName(rest)
