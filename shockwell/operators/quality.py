"""Checks and cleaning of candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.columns import ln_positive, require_columns, series

RULES = ("null_close", "nonpositive_price", "duplicate_begin", "high_below_body", "low_above_body")


def quality_report(candles: DataFrame) -> DataFrame:
    """(asset, rule, violations) for every rule of RULES, counted in one pass."""
    require_columns(candles, {"asset", "begin", "open", "high", "low", "close"})
    counts = candles.groupBy("asset").agg(
        F.count_if(F.col("close").isNull()).alias("null_close"),
        F.count_if((F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)).alias("nonpositive_price"),
        (F.count("begin") - F.count_distinct("begin")).alias("duplicate_begin"),
        F.count_if(F.col("high") < F.greatest("open", "close", "low")).alias("high_below_body"),
        F.count_if(F.col("low") > F.least("open", "close", "high")).alias("low_above_body"),
    )
    return counts.unpivot("asset", list(RULES), "rule", "violations")


def gap_days(begin: str = "begin") -> Column:
    """Days from the bar before, null for an asset's first."""
    return F.timestamp_diff("MICROSECOND", F.lag(begin).over(series()), F.col(begin)) / 86_400_000_000.0


def after_long_gap(max_days: float | None) -> Column:
    return F.lit(False) if max_days is None else F.coalesce(gap_days() > max_days, F.lit(False))


def log_returns(candles: DataFrame, price: str = "close", max_gap_days: float | None = None, out: str = "log_return") -> DataFrame:
    """ln p - ln of the price before; null after a gap of more than `max_gap_days`."""
    log = ln_positive(price)
    return candles.withColumn(out, F.when(~after_long_gap(max_gap_days), log - F.lag(log).over(series())))


def calendar_gaps(candles: DataFrame, threshold_days: float = 7, price: str = "close") -> DataFrame:
    """(asset, previous_timestamp, timestamp, gap_days, log_return) of bars more than `threshold_days` after the one before."""
    if threshold_days < 1:
        raise ValueError("threshold_days must be at least 1")
    rows = log_returns(candles, price).withColumn("previous_timestamp", F.lag("begin").over(series())).withColumn("gap_days", gap_days())
    return rows.where(F.col("gap_days") > threshold_days).select("asset", "previous_timestamp", F.col("begin").alias("timestamp"), "gap_days", "log_return")


def without_unfinished(candles: DataFrame, today: str) -> DataFrame:
    """Without each asset's last bar if its day is `today` or later; `dropped` tells which assets lost it."""
    last = F.max("pos").over(Window.partitionBy("asset")) == F.col("pos")
    open_ = last & (F.to_date("begin") >= F.lit(today).cast("date"))
    marked = candles.withColumn("_open", F.coalesce(open_, F.lit(False)))
    return marked.withColumn("dropped", F.max("_open").over(Window.partitionBy("asset"))).where(~F.col("_open")).drop("_open")


def prepared_hourly(candles: DataFrame, first_hour: int = 10, last_hour: int = 18) -> DataFrame:
    """Bars with positive prices and volume, the first of each begin, with date parts, in-bar return and session flag."""
    require_columns(candles, {"asset", "begin", "open", "high", "low", "close", "volume"})
    positive = " and ".join(f"{c} > 0" for c in ("open", "high", "low", "close", "volume"))
    rows = candles.where(f"begin is not null and {positive}")
    order = F.col("load") if "load" in candles.columns else F.lit(0)
    first = Window.partitionBy("asset", "begin").orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumns(
        {
            "date": F.to_date("begin"),
            "year": F.year("begin"),
            "hour": F.hour("begin"),
            "log_return_oc": F.ln(F.col("close") / F.col("open")),
            "price_increment": F.col("close") - F.col("open"),
            "price": F.col("open"),
            "regular_session": F.hour("begin").between(first_hour, last_hour),
            "pos": (F.row_number().over(Window.partitionBy("asset").orderBy("begin")) - 1).cast("int"),
        }
    )


def display_columns(candles: DataFrame) -> DataFrame:
    """(asset, bars, has_volume): whether an asset's volume says anything."""
    return candles.groupBy("asset").agg(F.count("*").alias("bars"), (F.max(F.abs(F.coalesce("volume", F.lit(0.0)))) > 0).alias("has_volume"))


def large_enough(rows: DataFrame, least: int) -> DataFrame:
    """Rows of assets that have at least `least` of them."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("asset"))).where(F.col("_n") >= least).drop("_n")
