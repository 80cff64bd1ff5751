"""Variance proxies from candles, rolling volatility, moments and asymmetry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.columns import ANNUAL, average_rank, clip, divide, ln_positive, median, quantile, rolling, series, trailing
from shockwell.functions.sketches import sketch_quantile
from shockwell.operators.quality import after_long_gap

PROXIES = ["close_to_close", "parkinson", "garman_klass", "rogers_satchell", "gap_rogers_satchell", "yang_zhang_contribution"]
PROXY_COLUMNS = [*PROXIES, "overnight_gap_squared", "intraday_rs", "close_return", "overnight_return", "open_to_close_return"]
#: Fixed value: what keeps the ratio of two half-variances finite.
TINY = 2.220446049250313e-16


def _logs(candles: DataFrame, max_gap: float | None) -> DataFrame:
    df = candles.withColumns({f"_{c[0]}": ln_positive(c) for c in ("open", "high", "low", "close")}).withColumn("_gap", after_long_gap(max_gap))
    prev = F.lag("_c").over(series())
    return df.withColumns(
        {
            "close_return": F.when(~F.col("_gap"), F.col("_c") - prev),
            "overnight_return": F.when(~F.col("_gap"), F.col("_o") - prev),
            "open_to_close_return": F.col("_c") - F.col("_o"),
            "rogers_satchell": clip((F.col("_h") - F.col("_o")) * (F.col("_h") - F.col("_c")) + (F.col("_l") - F.col("_o")) * (F.col("_l") - F.col("_c")), low=0.0),
        }
    )


def variance_proxies(candles: DataFrame, center: int = 20, max_gap_days: float | None = None) -> DataFrame:
    """`candles` with the columns of PROXY_COLUMNS. One window order serves them all.

    The Yang-Zhang contribution is centred on the means of the `center` bars before, so it never looks ahead.
    """
    if center < 5:
        raise ValueError("center must be at least 5")
    df = _logs(candles, max_gap_days)
    k = 0.34 / (1.34 + (center + 1) / (center - 1))
    on, oc, span = F.col("overnight_return"), F.col("open_to_close_return"), F.col("_h") - F.col("_l")
    off = {n: F.col(n) - rolling(F.avg, n, -center, -1) for n in ("overnight_return", "open_to_close_return")}
    df = df.withColumns(
        {
            "close_to_close": F.col("close_return") * F.col("close_return"),
            "parkinson": span * span / (4 * math.log(2)),
            "garman_klass": clip(0.5 * span * span - (2 * math.log(2) - 1) * oc * oc, low=0.0),
            "gap_rogers_satchell": on * on + F.col("rogers_satchell"),
            "overnight_gap_squared": on * on,
            "intraday_rs": F.col("rogers_satchell"),
            "_on": off["overnight_return"],
            "_oc": off["open_to_close_return"],
        }
    )
    yz = F.col("_on") * F.col("_on") + k * F.col("_oc") * F.col("_oc") + (1 - k) * F.col("rogers_satchell")
    return df.withColumn("yang_zhang_contribution", yz).drop("_o", "_h", "_l", "_c", "_gap", "_on", "_oc")


def rolling_volatility(df: DataFrame, variance: str, window: int, out: str = "volatility", annual: float = ANNUAL) -> DataFrame:
    """Annualised square root of the rolling mean of a variance."""
    if window < 2:
        raise ValueError("window must be at least 2")
    return df.withColumn(out, F.sqrt(annual * trailing(F.avg, clip(variance, low=0.0), window)))


def yang_zhang_volatility(candles: DataFrame, window: int, annual: float = ANNUAL, max_gap_days: float | None = None) -> DataFrame:
    if window < 3:
        raise ValueError("window must be at least 3")
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    parts = trailing(F.var_samp, "overnight_return", window) + k * trailing(F.var_samp, "open_to_close_return", window) + (1 - k) * trailing(F.avg, "rogers_satchell", window)
    df = _logs(candles, max_gap_days).withColumn("_v", parts)
    return df.withColumn("yang_zhang_volatility", F.sqrt(annual * clip("_v", low=0.0))).drop("_v", "_o", "_h", "_l", "_c", "_gap")


def close_to_close_volatility(df: DataFrame, returns: str, window: int, annual: float = ANNUAL) -> DataFrame:
    return df.withColumn("close_to_close_volatility", F.sqrt(annual * trailing(F.var_pop, returns, window)))


def parkinson_volatility(candles: DataFrame, window: int, annual: float = ANNUAL) -> DataFrame:
    span = ln_positive(divide("high", "low"))
    df = candles.withColumn("_range", span * span)
    return df.withColumn("parkinson_volatility", F.sqrt(annual * trailing(F.avg, "_range", window) / (4 * math.log(2)))).drop("_range")


#: Bars of one fold; a fold's answers are an array that grows by copying.
EWMA_BLOCK = 256


def ewma_volatility(df: DataFrame, returns: str, span: int = 20, annual: float = ANNUAL) -> DataFrame:
    """Exponentially weighted, with the weight of missing bars decaying too; null before `span` values.

    A segmented scan: blocks of EWMA_BLOCK bars are folded each for itself into the weight that is left to the bars before,
    mean and variance; the blocks' ends are combined in order, and each bar adds its block's start. The work is linear in a
    history's length.
    """
    if span < 2:
        raise ValueError("span must be at least 2")
    alpha = 2.0 / (span + 1)
    x = F.col(returns)
    past = series().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(x.isNotNull(), F.col("pos")), ignorenulls=True).over(past)
    weight = F.when(last.isNull(), 1.0).otherwise(alpha / (F.pow(F.lit(1 - alpha), F.col("pos") - last) + alpha))
    seen = F.count(x).over(series().rowsBetween(Window.unboundedPreceding, 0))
    rows = df.select("asset", "pos", x.alias("x"), weight.alias("w"), seen.alias("n"), F.floor(F.col("pos") / EWMA_BLOCK).alias("block"))
    blocks = rows.groupBy("asset", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "w", "n"))).alias("s"))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.array().cast("array<struct<pos:int,n:bigint,a:double,m:double,v:double>>").alias("out"))

    def step(acc, row):
        missing = row["x"].isNull()
        a = acc["a"] * (1 - row["w"])
        u, d = row["w"] / (1 - a), row["x"] - acc["m"]
        a = F.when(missing, acc["a"]).otherwise(a)
        m = F.when(missing, acc["m"]).otherwise(acc["m"] + u * d)
        v = F.when(missing, acc["v"]).otherwise((1 - u) * (acc["v"] + u * d * d))
        told = F.struct(row["pos"].alias("pos"), row["n"].alias("n"), a.alias("a"), m.alias("m"), v.alias("v"))
        return F.struct(a.alias("a"), m.alias("m"), v.alias("v"), F.concat(acc["out"], F.array(told)).alias("out"))

    def joined(before, own):
        """Mean and variance of what is before a block and `own` of it together."""
        a, d = own["a"], before["m"] - own["m"]
        return a * before["m"] + (1 - a) * own["m"], a * before["v"] + (1 - a) * own["v"] + a * (1 - a) * d * d

    folded = blocks.select("asset", "block", F.aggregate("s", start, step)["out"].alias("out"))
    ends = folded.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("block", F.element_at("out", -1).alias("e")))).alias("s"))
    nothing = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.array().cast("array<struct<block:bigint,m:double,v:double>>").alias("out"))

    def carry(acc, row):
        m, v = joined(acc, row["e"])
        return F.struct(m.alias("m"), v.alias("v"), F.concat(acc["out"], F.array(F.struct(row["block"].alias("block"), acc["m"].alias("m"), acc["v"].alias("v")))).alias("out"))

    starts = ends.select("asset", F.explode(F.aggregate("s", nothing, carry)["out"]).alias("b")).select("asset", F.col("b.block").alias("block"), "b")
    each = folded.join(starts, ["asset", "block"]).select("asset", "b", F.explode("out").alias("o"))
    found = each.select("asset", F.col("o.pos").alias("pos"), F.when(F.col("o.n") >= span, F.sqrt(annual * joined(F.col("b"), F.col("o"))[1])).alias("ewma_volatility"))
    return df.join(found, ["asset", "pos"])


def proxy_correlations(df: DataFrame, names: list[str] = PROXIES) -> DataFrame:
    """(asset, a, b, rho): Spearman correlation of each pair of proxies over the bars that have both."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    rows = df.select("asset", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])))
    both = rows.where("x is not null and y is not null")
    ranked = both.withColumn("rx", average_rank("x", "asset", "a", "b")).withColumn("ry", average_rank("y", "asset", "a", "b"))
    return ranked.groupBy("asset", "a", "b").agg(F.corr("rx", "ry").alias("rho"))


def proxy_disagreement(df: DataFrame, top: int = 20, names: list[str] = PROXIES, sketch: int | None = None) -> DataFrame:
    """Each asset's `top` bars whose proxies, relative to their medians, differ most; earlier bars win ties. With `sketch`, a
    size, the medians come from sketches of the bars, all in one aggregation, instead of a sort of each asset's values."""
    group = Window.partitionBy("asset")
    if sketch is None:
        mids = df.withColumns({f"_m{k}": median(n).over(group) for k, n in enumerate(names)})
    else:
        sketches = df.groupBy("asset").agg(*[F.kll_sketch_agg_double(n, F.lit(sketch)).alias(f"_k{k}") for k, n in enumerate(names)])
        own = [F.when(F.kll_sketch_get_n_double(f"_k{k}") > 0, sketch_quantile(f"_k{k}", 0.5)).alias(f"_m{k}") for k in range(len(names))]
        mids = df.join(sketches.select("asset", *own), "asset")
    rel = [F.when(F.col(f"_m{k}") != 0, F.col(n) / F.col(f"_m{k}")) for k, n in enumerate(names)]
    df = mids.withColumn("disagreement", F.greatest(*rel) - F.least(*rel)).drop(*[f"_m{k}" for k in range(len(names))])
    rank = F.row_number().over(group.orderBy(F.desc_nulls_last("disagreement"), "pos"))
    return df.where("disagreement is not null").withColumn("rank", rank).where(F.col("rank") <= top)


def rolling_moments(df: DataFrame, returns: str, window: int) -> DataFrame:
    """Mean, second and third central moment, its signed cube root and skewness of the trailing window."""
    if window < 3:
        raise ValueError("window must be at least 3")
    frame = series().rowsBetween(-(window - 1), 0)
    values = F.collect_list(returns).over(frame)
    full = F.count(returns).over(frame) == window
    df = df.withColumn("_x", F.when(full, values)).withColumn("rolling_mean", F.when(full, F.avg(returns).over(frame)))

    def moment(k: int):
        return F.aggregate("_x", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("rolling_mean"), float(k))) / window

    df = df.withColumn("m2", moment(2)).withColumn("m3", moment(3)).drop("_x")
    return df.withColumn("signed_cuberoot_m3", F.signum("m3") * F.cbrt(F.abs("m3"))).withColumn("skewness", F.when(F.col("m2") > 0, F.col("m3") / F.pow("m2", F.lit(1.5))))


def clipped_moment(df: DataFrame, name: str = "m3") -> DataFrame:
    """A moment for display: clipped to its 1 % and 99 % quantiles."""
    group = Window.partitionBy("asset")
    low, high = quantile(name, 0.01).over(group), quantile(name, 0.99).over(group)
    return df.withColumn(f"{name}_clipped", F.when(F.col(name).isNotNull(), F.greatest(F.least(F.col(name), high), low)))


def rolling_asymmetry(df: DataFrame, returns: str, window: int) -> DataFrame:
    """Share of downside variance, log ratio of the half-variances, and quantile skewness. A missing return counts as 0 in
    the half-variances, and as missing in the quantiles."""
    if window < 5:
        raise ValueError("window must be at least 5")
    r = F.col(returns)
    full = series().rowsBetween(-(window - 1), 0)
    rows = F.count("*").over(full) == window
    down = F.when(rows, F.sum(F.when(r < 0, r * r).otherwise(0.0)).over(full))
    up = F.when(rows, F.sum(F.when(r > 0, r * r).otherwise(0.0)).over(full))
    q = F.when(F.count(r).over(full) == window, F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(full))
    df = df.withColumn("_down", down).withColumn("_up", up).withColumn("_q", q)
    spread = F.col("_q")[2] - F.col("_q")[0]
    return df.withColumns(
        {
            "downside_variance_share": F.when(F.col("_down") + F.col("_up") > 0, F.col("_down") / (F.col("_down") + F.col("_up"))),
            "downside_upside_log_ratio": F.ln((F.col("_down") + TINY) / (F.col("_up") + TINY)),
            "quantile_skewness": F.when(spread > 0, (F.col("_q")[2] + F.col("_q")[0] - 2 * F.col("_q")[1]) / spread),
        }
    ).drop("_down", "_up", "_q")
