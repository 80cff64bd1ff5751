"""As-of joins: each row of one table with the last (or next) row of another at its time, by equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a stretch of time should hold on average.
STRETCH_ROWS = 1_000_000


def _micros(time: str, dtype: str) -> Column:
    """Times as whole numbers: microseconds of timestamps and dates, numbers as they are."""
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(time).cast("timestamp"))
    return F.col(time)


def asof_join(
    left: DataFrame, right: DataFrame, time: str, by: list[str], columns: list[str], tolerance: float | None = None, direction: str = "backward",
    exact: bool = True, order: list[str] | None = None, prefix: str = "", inner: bool = False, stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """`left` with `time` and `columns` of the last row of `right` at or before its time (direction "forward": the next at or
    after it) among those with equal `by`, as columns named `prefix` + name (the time as `prefix` + "matched_" + time).

    `exact` false leaves out rows at the very time. `tolerance` (in seconds for timestamps and dates, else in the unit of
    `time`) leaves a row unmatched whose partner is farther away. Of right rows with one key and time the last by `order`
    counts (ties in it too: the largest by `columns`). Rows without a partner have nulls, or are left out with `inner`.

    No join by range is made: both tables' rows are laid in one order of time and the last right row is carried forward. A
    key is cut into stretches of time of about `stretch_rows` rows, so that one that holds a third of all rows is many tasks;
    what a stretch hands to the next is one row, and those are carried through their own small window.

    Null times and null keys match nothing; rows of `left` that have them, and repeated ones, all stay. An empty `right`
    matches nothing. Columns of `left` named like new ones are an error.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    new = [f"{prefix}matched_{time}", *[f"{prefix}{c}" for c in columns]]
    taken = {c.lower() for c in left.columns} & {c.lower() for c in new}
    if taken:
        raise ValueError(f"columns of both sides: {sorted(taken)}; name a prefix")
    kind = left.schema[time].dataType.simpleString()
    sign = 1 if direction == "backward" else -1
    keys = [f"_key{k}" for k in range(len(by))]
    at = _micros(time, kind) * sign
    unit = 1_000_000 if kind in ("timestamp", "timestamp_ntz", "date") else 1
    asked = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], at.alias("_at"))
    held = F.struct(F.col(time).alias("t"), F.struct(*[F.col(c) for c in columns]).alias("c"))
    turn = F.struct(*[F.col(c) for c in order or []], held["c"].alias("_c"))
    given = right.where(F.col(time).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], _micros(time, right.schema[time].dataType.simpleString()).alias("_at"), held.alias("_held"), turn.alias("_turn"))
    for k in keys:
        given = given.where(F.col(k).isNotNull())
    latest = given.groupBy(*keys, "_at").agg(F.max_by("_held", "_turn").alias("_held")).withColumn("_at", F.col("_at") * sign)
    both = asked.withColumn("_side", F.lit(1 if exact else 0)).unionByName(latest.withColumn("_side", F.lit(0 if exact else 1)), allowMissingColumns=True)
    low, high, n = both.agg(F.min("_at"), F.max("_at"), F.count("*")).first()
    stretches = max(1, -(-n // stretch_rows))
    width = max((high - low) / stretches, 1) if low is not None else 1
    rows = both.withColumn("_stretch", F.floor((F.col("_at") - F.lit(low)) / F.lit(width)).cast("long") if low is not None else F.lit(0).cast("long"))
    # the last right row of each stretch, carried to the stretches after it
    ends = rows.where("_held is not null").groupBy(*keys, "_stretch").agg(F.max_by("_held", "_at").alias("_end"))
    places = rows.select(*keys, "_stretch").distinct().join(ends, [*keys, "_stretch"], "left")
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_carried is not null").drop("_end")
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last("_held", ignorenulls=True).over(inside)).where("_left is not null").join(carried, [*keys, "_stretch"], "left")
    match = F.coalesce("_found", "_carried")
    there = F.col("_at").isNotNull()
    for k in keys:
        there = there & F.col(k).isNotNull()
    if tolerance is not None:
        there = there & (F.col("_at") - _micros("_match.t", right.schema[time].dataType.simpleString()) * sign <= tolerance * unit)
    done = found.withColumn("_match", match).withColumn("_match", F.when(there, F.col("_match")))
    out = done.where("_match is not null") if inner else done
    return out.select("_left.*", F.col("_match.t").alias(new[0]), *[F.col(f"_match.c.`{c}`").alias(p) for c, p in zip(columns, new[1:], strict=True)])
