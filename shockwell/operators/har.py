"""Past-only forecasts of log variance from daily, weekly and monthly means, and robust innovation scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.columns import EPSILON, MAD_SCALE, clip, rolling, series
from shockwell.functions.numeric import huber, ols_hac

COEFFICIENTS = ["har_const", "har_daily", "har_weekly", "har_monthly", "har_smearing"]
#: Values that the monthly state needs; innovations that a score needs.
MONTH, LEAST_SCORED = 22, 30


def har_design(df: DataFrame, variance: str) -> DataFrame:
    """Target ln q and the states of the bars before: lag 1, mean of lags 1 to 5 and 1 to 22; a gap leaves them null."""
    q = F.when(F.col(variance) > 0, F.col(variance))
    names = {"log_daily": 1, "log_weekly": 5, "log_monthly": MONTH}
    return df.withColumns({"target": F.ln(q + EPSILON), **{n: F.ln(rolling(F.avg, q, -k, -1) + EPSILON) for n, k in names.items()}})


def bound(x: Column, work: Callable[[Column], Column]) -> Column:
    """work(x) with x computed once, however often `work` uses it."""
    return F.get(F.transform(F.array(x), work), F.lit(0))


def array_median(x: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return bound(F.sort_array(x), middle)


def with_history(df: DataFrame, variance: str) -> DataFrame:
    """`df` with history: the last 22 positive variances before each bar, null with fewer; others count as missing."""
    there = F.coalesce(F.col(variance) > 0, F.lit(False))
    recent = F.collect_list(variance).over(Window.partitionBy("asset", there).orderBy("pos").rowsBetween(-(MONTH - 1), 0))
    rows = df.withColumn("_recent", F.when(there, recent))
    rows = rows.withColumn("history", F.last("_recent", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))).drop("_recent")
    return rows.withColumn("history", F.when(F.size("history") == MONTH, F.col("history")))


def with_raw_history(df: DataFrame, variance: str, name: str = "raw_history") -> DataFrame:
    """`df` with the variances of the last 22 bars before each one, null if one of them is missing or not positive."""
    own = F.when(~F.isnan(variance), F.col(variance))
    recent = F.collect_list(own).over(series().rowsBetween(-MONTH, -1))
    return df.withColumn(name, recent).withColumn(name, F.when((F.size(name) == MONTH) & (F.array_min(name) > 0), F.col(name)))


def _mean_last(history: Column, n: int) -> Column:
    return F.aggregate(F.slice(history, -n, n), F.lit(0.0), lambda a, x: a + x) / n


def log_forecast(history: Column) -> Column:
    """Coefficients times the state of a history of at least 22 positive values: the median path's next logarithm."""
    parts = (F.element_at(history, -1), _mean_last(history, 5), _mean_last(history, MONTH))
    return F.col("har_const") + sum((F.col(c) * F.ln(x + EPSILON) for c, x in zip(COEFFICIENTS[1:4], parts, strict=True)), F.lit(0.0))


def recursive_path(history: Column, periods: int, smearing: bool = False) -> Column:
    """The next `periods` variances if nothing happens, each feeding the next: conditional medians, or means with `smearing`."""

    def step(acc: Column, _: Column) -> Column:
        x = F.exp(clip(log_forecast(acc), -40.0, 20.0))
        return F.concat(acc, F.array(x * F.col("har_smearing") if smearing else x))

    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(periods)), history, step), MONTH + 1, periods)


def _refit(initial: int, every: int, robust: bool):
    names = ["asset", "block", "fit_pos", *COEFFICIENTS]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        pos, y = rows["pos"].to_numpy(), rows["target"].to_numpy()
        x = np.column_stack([np.ones(len(rows)), rows[["log_daily", "log_weekly", "log_monthly"]].to_numpy()])
        out = []
        last = int(rows["last"].iloc[0])
        for block, begin in enumerate(range(initial, last + 1, every)):
            tried = range(begin, min(begin + every, last + 1))
            known = {p: int(np.searchsorted(pos, p)) for p in tried}
            fit = next((p for p in tried if known[p] >= max(120, min(initial, p // 2))), None)
            if fit is None:
                continue
            n = known[fit]
            beta = huber(x[:n], y[:n]) if robust else ols_hac(x[:n], y[:n], 0).beta
            smear = float(np.exp(np.clip(y[:n] - x[:n] @ beta, -20, 20)).mean())
            out.append((rows["asset"].iloc[0], block, fit, *beta, smear if np.isfinite(smear) and smear > 0 else 1.0))
        return pd.DataFrame(out, columns=names)

    return run


def fit_coefficients(df: DataFrame, variance: str, initial: int = 252, every: int = 20, robust: bool = True) -> DataFrame:
    """(asset, block, fit_pos, coefficients): fits on all bars before each refit position, one for each block of `every`
    bars from `initial` on. Where too few bars are known at a block's first bar, the next one tries. Only design rows travel."""
    last = df.groupBy("asset").agg(F.max("pos").alias("last"))
    rows = har_design(df, variance).select("asset", "pos", "target", "log_daily", "log_weekly", "log_monthly").dropna().join(last, "asset")
    return rows.groupBy("asset").applyInPandas(_refit(initial, every, robust), "asset string, block int, fit_pos int, " + ", ".join(f"{c} double" for c in COEFFICIENTS))


def innovations(df: DataFrame, variance: str, initial: int = 252, every: int = 20, mad_window: int = 250, robust: bool = True, coefficients: dict[str, float] | None = None) -> DataFrame:
    """`df` with forecasts, innovations and shock scores. Nothing of a bar or after it enters its forecast or scale.

    A bar uses the coefficients of its block of bars, which follows from its own position: an equi-join. Variances that
    aren't positive count as missing, here and in variance_proxy.
    With given `coefficients` (by name as in COEFFICIENTS) nothing is fitted. The score compares an innovation with the
    median and MAD of the `mad_window` innovations before it, 30 at least.
    """
    if initial < 120 or every < 1 or mad_window < LEAST_SCORED:
        raise ValueError("initial must be at least 120, every 1, mad_window 30")
    rows = with_history(df, variance).withColumn("variance_proxy", F.when(F.col(variance) > 0, F.col(variance))).withColumn("actual_log_variance", F.when(F.col(variance) > 0, F.ln(F.col(variance) + EPSILON)))
    if coefficients is None:
        fits = fit_coefficients(df, variance, initial, every, robust)
        rows = rows.withColumn("block", F.floor((F.col("pos") - initial) / every).cast("int")).join(fits, ["asset", "block"], "left")
        rows = rows.withColumns({c: F.when(F.col("pos") >= F.col("fit_pos"), F.col(c)) for c in COEFFICIENTS}).drop("block", "fit_pos")
    else:
        rows = rows.withColumns({c: F.lit(float(coefficients[c])) for c in COEFFICIENTS})
    ready = (F.col("pos") >= initial) & (F.col(variance) > 0) & F.col("history").isNotNull()
    rows = rows.withColumn("forecast_variance", F.when(ready, F.exp(clip(log_forecast(F.col("history")), -40.0, 20.0)) * F.col("har_smearing")))
    rows = rows.withColumn("forecast_log_variance", F.ln(F.col("forecast_variance") + EPSILON))
    rows = rows.withColumn("innovation", F.col("actual_log_variance") - F.col("forecast_log_variance"))
    rows = rows.withColumns({c: F.when(F.col("innovation").isNotNull(), F.col(c)) for c in COEFFICIENTS})
    known = F.col("innovation").isNotNull()
    past = F.collect_list("innovation").over(Window.partitionBy("asset", known).orderBy("pos").rowsBetween(-mad_window, -1))
    rows = rows.withColumn("_past", F.when(known, past)).withColumn("_past", F.when(F.size("_past") >= LEAST_SCORED, F.col("_past")))
    rows = rows.withColumn("_mid", array_median(F.col("_past")))
    spread = bound(F.col("_mid"), lambda mid: array_median(F.transform("_past", lambda x: F.abs(x - mid))))
    rows = rows.withColumn("_scale", MAD_SCALE * spread)
    usable = F.col("_scale") > 1e-8
    scored = {"innovation_scale": F.when(usable, F.col("_scale")), "shock_score": F.when(usable, (F.col("innovation") - F.col("_mid")) / F.col("_scale"))}
    return rows.withColumns(scored).drop("_past", "_mid", "_scale")
