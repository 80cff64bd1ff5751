"""Shock detection: a quantile threshold, then greedy suppression of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.columns import quantile, rolling, series
from shockwell.functions.sketches import sketched_thresholds


def suppressed(df: DataFrame, score: str, q: float, cooldown: int, sketch: int | None = None) -> DataFrame:
    """Rows at or above the asset's q-quantile of `score` that keep more than `cooldown` bars from every stronger one kept.

    Candidates are taken from the strongest down, ties from the earliest; the fold over an asset's candidates is one
    expression. Adds threshold and event_id, which counts the kept rows of an asset from 0 in the order of time. With
    `sketch`, a size, the quantile comes from a sketch (a rank off by `rank_error(sketch)`), which combines before the shuffle.
    """
    if not 0.5 < q < 1 or cooldown < 0:
        raise ValueError("the quantile must be above 0.5 and below 1, cooldown not negative")
    bars = df.groupBy("asset").agg(quantile(score, q).alias("threshold")) if sketch is None else sketched_thresholds(df, score, ["asset"], q, sketch).drop("n")
    hot = df.join(bars, "asset").where(F.col(score) >= F.col("threshold"))
    order = hot.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "pos"))).alias("c"))
    kept = F.aggregate("c", F.array().cast("array<int>"), lambda acc, x: F.when(F.exists(acc, lambda p: F.abs(p - x["pos"]) <= cooldown), acc).otherwise(F.concat(acc, F.array(x["pos"]))))
    chosen = order.select("asset", F.explode(kept).alias("pos"))
    number = F.row_number().over(Window.partitionBy("asset").orderBy("pos")) - 1
    return hot.join(chosen, ["asset", "pos"]).withColumn("event_id", number)


def direction(returns: str):
    return F.when(F.col(returns) < 0, "negative").when(F.col(returns) > 0, "positive").otherwise("zero")


def volatility_shocks(diagnostics: DataFrame, returns: str = "close_return", q: float = 0.95, cooldown: int = 10, sketch: int | None = None) -> DataFrame:
    """Events with direction, share of the overnight gap and what dominated."""
    rows = suppressed(diagnostics, "shock_score", q, cooldown, sketch)
    total = F.col("overnight_gap_squared") + F.col("intraday_rs")
    rows = rows.withColumn("direction", direction(returns)).withColumn("gap_share", F.when(total > 0, F.col("overnight_gap_squared") / total))
    return rows.withColumn("source", F.when(F.col("gap_share") >= 0.67, "overnight-dominated").when(F.col("gap_share") <= 0.33, "intraday-dominated").otherwise("mixed"))


def filtered(events: DataFrame, which: str) -> DataFrame:
    if which not in ("all", "negative", "positive", "zero"):
        raise ValueError(f"unknown direction {which!r}")
    return events if which == "all" else events.where(F.col("direction") == which)


def return_score(df: DataFrame, returns: str, lookback: int = 60) -> DataFrame:
    """|r| over the standard deviation of the `lookback` returns before."""
    past = rolling(F.stddev_pop, returns, -lookback, -1)
    return df.withColumn("past_sigma", past).withColumn("return_score", F.when(F.col("past_sigma") > 0, F.abs(returns) / F.col("past_sigma")))


def return_shocks(df: DataFrame, returns: str, lookback: int = 60, q: float = 0.95, cooldown: int = 10, which: str = "all") -> DataFrame:
    rows = suppressed(return_score(df, returns, lookback), "return_score", q, cooldown)
    return filtered(rows.withColumn("direction", F.when(F.col(returns) < 0, "negative").otherwise("positive")), which)


def volatility_peaks(df: DataFrame, level: str, q: float = 0.95, cooldown: int = 10) -> DataFrame:
    return suppressed(df, level, q, cooldown)


def indicators(df: DataFrame, events: DataFrame) -> DataFrame:
    """`df` with 0/1 columns negative_event and positive_event; events without direction count as neither."""
    marks = events.select("asset", "pos", F.col("direction").alias("_d"))
    rows = df.join(marks, ["asset", "pos"], "left")
    return rows.withColumns({f"{d}_event": F.coalesce((F.col("_d") == d).cast("double"), F.lit(0.0)) for d in ("negative", "positive")}).drop("_d")


def near_events(df: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Distinct (asset, pos) from `before` bars before to `after` bars after any event."""
    span = F.explode(F.sequence(F.col("pos") - before, F.col("pos") + after))
    return events.select("asset", span.alias("pos")).distinct()


def greedy_in_time(df: DataFrame, score: str, q: float, cooldown: int, first: int, ahead: int) -> DataFrame:
    """Rows with score at or above the quantile, taken in the order of time if at least `cooldown` after the last one taken,
    from position `first` on and with `ahead` bars after them. event_id is the number among all candidates."""
    group = Window.partitionBy("asset")
    rows = df.withColumn("threshold", quantile(score, q).over(group)).withColumn("_n", F.count("*").over(group))
    hot = rows.where(F.col(score) >= F.col("threshold")).withColumn("event_id", F.row_number().over(series()) - 1)
    fits = hot.where((F.col("pos") >= first) & (F.col("pos") + ahead < F.col("_n"))).drop("_n")
    order = fits.groupBy("asset").agg(F.array_sort(F.collect_list("pos")).alias("c"))
    kept = F.aggregate("c", F.array().cast("array<int>"), lambda acc, x: F.when(x - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-(10**9))) < cooldown, acc).otherwise(F.concat(acc, F.array(x))))
    return fits.join(order.select("asset", F.explode(kept).alias("pos")), ["asset", "pos"])
