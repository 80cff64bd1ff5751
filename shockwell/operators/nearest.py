"""Exact nearest neighbours where distance grows with time apart: the rows to compare come from a bound, not from all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.storage import written


def nearest_in_time(
    events: DataFrame, pool: DataFrame, by: list[str], event: str, at: str, other: str, distance: Column, rate: float, k: int,
    tie: str, reach: float | None = None, stretch: int | None = None, width: float = 512.0,
) -> DataFrame:
    """Each event with its `k` rows of `pool` of smallest `distance`, ties by `tie`: the columns of both, `distance` and `rank`.

    `at` and `other` are numbers for the times of events and pool rows. `distance`, a column over both sides, must be at
    least `rate` times the time between them. With `reach` an event that has `k` pool rows within it takes no others.
    `event` is a key of the events of one group `by`; the sides share no column names but `by`.

    First an event meets its neighbours in time, `stretch` rows of the pool on either side (at least `k`); the k-th smallest
    distance among those bounds the answer's, and divided by `rate` it says how far away in time a row can still be as near.
    Then it meets the rows within that time only, by buckets of `width`. A group's history can be of any length: what an
    event meets follows its bound. Groups with fewer than `k` pool rows give all of them; events without any give no row.
    """
    stretch = max(stretch or 0, k)
    events, pool = written(events, "events"), written(pool, "pool")  # both are read twice
    numbered = pool.withColumn("_index", F.row_number().over(Window.partitionBy(*by).orderBy(other, tie)))
    marks = events.select(*by, event, F.col(at).alias("_at"), F.lit(0).alias("_pool"))
    marks = marks.unionByName(pool.select(*by, F.col(other).alias("_at"), F.lit(1).alias("_pool")), allowMissingColumns=True)
    group = Window.partitionBy(*by)
    so_far = group.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    extent = [f(F.when(F.col("_pool") == 1, F.col("_at"))).over(group).alias(n) for f, n in ((F.min, "_first"), (F.max, "_last"))]
    placed = marks.select(*by, event, "_pool", F.sum("_pool").over(so_far).alias("_before"), *extent).where("_pool = 0 and _first is not null")
    beside = F.sequence(F.col("_before") - stretch + 1, F.col("_before") + stretch)
    tried = placed.select(*by, event, "_first", "_last", F.explode(beside).alias("_index"))
    away = F.abs(F.col(at) - F.col(other))
    first = events.join(tried, [*by, event]).join(numbered, [*by, "_index"]).select(*by, event, at, "_first", "_last", away.alias("_away"), distance.alias("_d"))
    smallest = lambda x: F.array_sort(F.collect_list(x))
    inside = F.when(F.col("_away") <= reach, F.col("_d")) if reach is not None else F.lit(None).cast("double")
    known = first.groupBy(*by, event).agg(F.first(at).alias("_own"), F.first("_first").alias("_first"), F.first("_last").alias("_last"), F.max("_away").alias("_far"), smallest("_d").alias("_all"), smallest(inside).alias("_near"))
    local = F.size("_near") >= k
    bound = F.when(local, F.get("_near", F.lit(k - 1))).otherwise(F.get("_all", F.lit(k - 1)))
    radius = F.coalesce(bound / rate * (1 + 1e-9), F.col("_far"))
    if reach is not None:
        radius = F.when(local, F.least(radius, F.lit(float(reach)))).otherwise(radius)
    known = known.withColumn("_radius", radius)
    low = F.floor(F.greatest(F.col("_own") - F.col("_radius"), F.col("_first")) / width)
    high = F.floor(F.least(F.col("_own") + F.col("_radius"), F.col("_last")) / width)
    wanted = known.where(low <= high).select(*by, event, "_radius", F.explode(F.sequence(low, high)).alias("_bucket"))
    met = events.join(wanted, [*by, event]).join(pool.withColumn("_bucket", F.floor(F.col(other) / width)), [*by, "_bucket"]).where(away <= F.col("_radius"))
    met = met.withColumn("distance", distance).drop("_bucket", "_radius")
    order = Window.partitionBy(*by, event).orderBy("distance", tie)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
