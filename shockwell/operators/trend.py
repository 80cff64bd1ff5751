"""Trend, heterogeneous-horizon variance states, and regressions of future variance on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.columns import ANNUAL, EPSILON, average_rank, clip, ln_positive, median, quantile_bucket, rolling, trailing
from shockwell.functions.numeric import solve
from shockwell.functions.regression import newey_west, share_explained

BASE = ["log_daily", "log_weekly", "log_monthly"]
HINGES = ["negative_trend", "positive_trend"]


def cumulative_trend(df: DataFrame, returns: str, window: int) -> DataFrame:
    return df.withColumn("cumulative_trend", trailing(F.sum, returns, window))


def normalized_trend(df: DataFrame, returns: str, window: int, variance: str | None = None) -> DataFrame:
    """Sum of returns over the square root of the summed variance (squared returns without a proxy)."""
    q = clip(variance, low=0.0) if variance else F.col(returns) * F.col(returns)
    energy = trailing(F.sum, q, window)
    return df.withColumn("_e", energy).withColumn("normalized_trend", F.when(F.col("_e") > 0, trailing(F.sum, returns, window) / F.sqrt("_e"))).drop("_e")


def future_variance(df: DataFrame, variance: str, horizon: int) -> DataFrame:
    """Mean of the next `horizon` bars' variance; the bar itself takes no part."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    return df.withColumn("future_variance", rolling(F.avg, F.when(F.col(variance) >= 0, F.col(variance)), 1, horizon))


def har_state(df: DataFrame, variance: str) -> DataFrame:
    """Logarithms of the variance of the bar, and of the means of 5 and of 22 bars up to it."""
    q = F.when(F.col(variance) > 0, F.col(variance))
    return df.withColumns({n: F.ln(trailing(F.avg, q, k) + EPSILON) for n, k in zip(BASE, (1, 5, 22), strict=True)})


def trend_frame(df: DataFrame, returns: str, variance: str, window: int, horizon: int) -> DataFrame:
    """One row per bar for which trend, states and future variance are all there."""
    out = future_variance(har_state(normalized_trend(df, returns, window, variance), variance), variance, horizon)
    out = out.withColumn("future_volatility", F.sqrt(ANNUAL * clip("future_variance", low=0.0)))
    names = ["normalized_trend", *BASE, "future_variance", "future_volatility"]
    return out.select("asset", "pos", "begin", *names).dropna(subset=names)


def realized_volatility(df: DataFrame, returns: str, window: int, horizon: int, annual: float = ANNUAL) -> DataFrame:
    r2 = F.col(returns) * F.col(returns)
    return df.withColumns({"current_volatility": F.sqrt(annual * trailing(F.avg, r2, window)), "future_volatility": F.sqrt(annual * rolling(F.avg, r2, 1, horizon))})


def trend_volatility_frame(df: DataFrame, returns: str, window: int, horizon: int, current: int | None = None, annual: float = ANNUAL) -> DataFrame:
    """`trend_frame` with squared returns as the variance, and the volatility of the `current` bars up to each."""
    squares = df.withColumn("_r2", F.col(returns) * F.col(returns))
    now = squares.select("asset", "pos", F.sqrt(annual * trailing(F.avg, "_r2", current or window)).alias("current_volatility"))
    return trend_frame(squares, returns, "_r2", window, horizon).join(now, ["asset", "pos"]).dropna(subset=["current_volatility"])


def correlations(frame: DataFrame, x: str = "normalized_trend", y: str = "future_volatility", by: str = "asset") -> DataFrame:
    ranked = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_a", average_rank(x, by)).withColumn("_b", average_rank(y, by))
    n = F.count("*")
    return ranked.groupBy(by).agg(n.alias("observations"), F.when(n >= 3, F.corr(x, y)).alias("pearson"), F.when(n >= 3, F.corr("_a", "_b")).alias("spearman"))


def deciles(frame: DataFrame, groups: int = 10, x: str = "normalized_trend", y: str = "future_volatility") -> DataFrame:
    rows = frame.withColumn("bucket", quantile_bucket(x, groups, "asset"))
    return rows.groupBy("asset", "bucket").agg(F.avg(x).alias("trend_mean"), F.avg(y).alias("future_vol_mean"), median(y).alias("future_vol_median"), F.count("*").alias("observations"))


def regression_design(frame: DataFrame) -> DataFrame:
    rows = frame.dropna().where("future_variance > 0")
    return rows.withColumns({"y": ln_positive("future_variance"), "negative_trend": F.greatest(-F.col("normalized_trend"), F.lit(0.0)), "positive_trend": F.greatest("normalized_trend", F.lit(0.0))})


def normal_equations(design: DataFrame, terms: list[str], by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Sums of products of all terms and y by group: additive, so they combine before the shuffle."""
    names = [*terms, "y"]
    return design.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for k, a in enumerate(names) for b in names[k:]])


def fit_regressions(frame: DataFrame, hac_lags: int = 5, least: int = 120) -> DataFrame:
    """Least squares of ln future variance on the states and both trend hinges, with Newey-West errors, by asset and period;
    groups of fewer than `least` bars have none. baseline_r_squared is that of the states alone."""
    if hac_lags < 0:
        raise ValueError("hac_lags must not be negative")
    period = F.col("period") if "period" in frame.columns else F.lit("all")
    rows = regression_design(frame).select("asset", period.alias("period"), "pos", "y", F.lit(1.0).alias("const"), *BASE, *HINGES)
    by = ["asset", "period"]
    rows = rows.join(rows.groupBy(*by).agg(F.count("*").alias("observations")).where(F.col("observations") >= least), by)
    terms = ["const", *BASE, *HINGES]
    contrasts = {n: [float(n == m) for m in terms] for n in terms} | {"difference_down_minus_up": [0.0] * (len(terms) - 2) + [1.0, -1.0]}
    full = newey_west(rows, by, "pos", "y", terms, hac_lags, contrasts)
    base = share_explained(rows, by, "y", BASE).withColumnRenamed("r_squared", "baseline_r_squared")
    found = full.withColumnsRenamed({"n": "observations", "r_squared": "full_r_squared"}).join(base, by)
    return found.select(*by, "observations", "baseline_r_squared", "full_r_squared", "term", "estimate", "std_error", "z_value", "p_value", "ci_low", "ci_high")


def fit_regressions_by_period(frame: DataFrame, periods: list[tuple[str, str, str]] | None = None, hac_lags: int = 5, least: int = 80) -> DataFrame:
    """One fit for each named period [first day, last day]; a bar may lie in several."""
    spans = periods or [("first", "1995-01-01", "1997-12-31"), ("middle", "1998-01-01", "1999-12-31"), ("last", "2000-01-01", "2001-12-31")]
    table = frame.sparkSession.createDataFrame(spans, "period string, since string, until string").selectExpr("period", "cast(since as date) since", "cast(until as date) until")
    day = F.to_date("begin")
    rows = frame.join(F.broadcast(table), (day >= F.col("since")) & (day <= F.col("until"))).drop("since", "until")  # as many rows as periods were passed
    return fit_regressions(rows, hac_lags, least)


def qlike(df: DataFrame, actual: str, predicted: str, by: str = "asset") -> DataFrame:
    ratio = F.col(actual) / F.col(predicted)
    return df.where((F.col(actual) > 0) & (F.col(predicted) > 0)).groupBy(by).agg(F.avg(ratio - F.ln(ratio) - 1).alias("qlike"))


WALK = "asset string, test_year int, train_n long, test_n long, baseline_qlike double, full_qlike double, delta_qlike_full_minus_baseline double, baseline_log_mse double, full_log_mse double, delta_log_mse_full_minus_baseline double"


def walk_forward(frame: DataFrame, least: int = 500, least_test: int = 20) -> DataFrame:
    """For each year: coefficients from all years before, errors in the year itself, with and without the trend hinges.

    Sums of products by year are added up over the years before in a window, so training data moves once.
    """
    design = regression_design(frame).withColumn("year", F.year("begin")).withColumn("one", F.lit(1.0))
    terms = ["one", *BASE, *HINGES]
    sums = normal_equations(design, terms, ("asset", "year"))
    past = Window.partitionBy("asset").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in sums.columns if c.startswith("s_")]
    train = sums.select("asset", "year", F.sum("n").over(past).alias("train_n"), F.array(*[F.sum(c).over(past) for c in names]).alias("sums")).where(F.col("train_n") >= least)

    def solved(batches):
        k = len(terms)
        at = [(a, b) for a in range(k + 1) for b in range(a, k + 1)]
        for batch in batches:
            base, full = [], []
            for own in batch["sums"]:
                m = np.zeros((k + 1, k + 1))
                for (a, b), v in zip(at, own, strict=True):
                    m[a, b] = m[b, a] = v
                base.append([*solve(m[:-3, :-3], m[:-3, -1]), 0.0, 0.0])
                full.append(list(solve(m[:-1, :-1], m[:-1, -1])))
            yield batch.drop(columns="sums").assign(base=base, full=full)

    fitted = train.mapInPandas(solved, "asset string, year int, train_n long, base array<double>, full array<double>")
    rows = design.join(fitted, ["asset", "year"])

    def predicted(beta: str):
        return clip(sum((F.col(beta)[k] * F.col(t) for k, t in enumerate(terms)), F.lit(0.0)), -40.0, 20.0)

    rows = rows.withColumn("_b", predicted("base")).withColumn("_f", predicted("full"))
    q = lambda p: F.avg(F.exp(F.col("y") - F.col(p)) - (F.col("y") - F.col(p)) - 1)
    mse = lambda p: F.avg((F.col("y") - F.col(p)) * (F.col("y") - F.col(p)))
    out = rows.groupBy("asset", F.col("year").alias("test_year")).agg(F.max("train_n").alias("train_n"), F.count("*").alias("test_n"), q("_b").alias("baseline_qlike"), q("_f").alias("full_qlike"), mse("_b").alias("baseline_log_mse"), mse("_f").alias("full_log_mse"))
    out = out.where(F.col("test_n") >= least_test)
    return out.withColumns({"delta_qlike_full_minus_baseline": F.col("full_qlike") - F.col("baseline_qlike"), "delta_log_mse_full_minus_baseline": F.col("full_log_mse") - F.col("baseline_log_mse")})


def interpretation(coefficients: DataFrame) -> DataFrame:
    """A sentence per asset: how much a unit of falling or rising trend changes variance, and whether that is resolved."""
    one = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
    each = coefficients.groupBy("asset").agg(*[one(t, c).alias(f"{c}_{t}") for t in HINGES for c in ("estimate", "p_value")])
    text = F.format_string(
        "falling trend: %+.1f%% variance, %+.1f%% volatility (%s); rising trend: %+.1f%% variance, %+.1f%% volatility (%s)",
        *[x for t in HINGES for x in (100 * F.expm1(f"estimate_{t}"), 100 * F.expm1(F.col(f"estimate_{t}") / 2), F.when(F.col(f"p_value_{t}") < 0.05, "resolved").otherwise("not resolved"))],
    )
    return each.select("asset", text.alias("interpretation"))


def fit_legacy(df: DataFrame, least: int = 80) -> DataFrame:
    """The older form: one state three times over, so the solution of least norm is taken."""
    rows = df.select("asset", "pos", "normalized_trend", F.col("current_volatility").alias("v"), F.col("future_volatility").alias("f")).dropna().where("v > 0 and f > 0")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < least:
            return pd.DataFrame(columns=["asset", "observations", "term", "estimate"])
        state, t = np.log(part["v"] ** 2 / ANNUAL), part["normalized_trend"]
        x = np.column_stack([np.ones(len(part)), state, state, state, np.maximum(-t, 0), np.maximum(t, 0)])
        beta = np.linalg.pinv(x) @ np.log(part["f"] ** 2 / ANNUAL).to_numpy()
        return pd.DataFrame({"asset": part["asset"].iloc[0], "observations": len(part), "term": ["const", *BASE, *HINGES], "estimate": beta})

    return rows.groupBy("asset").applyInPandas(fit, "asset string, observations long, term string, estimate double")
