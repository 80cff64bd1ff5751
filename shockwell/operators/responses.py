"""What follows a shock: counterfactual paths, matched controls, local projections, and summaries by event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.columns import ANNUAL, EPSILON, MAD_SCALE, clip, divide, hash_draw, median, quantile, rolling, series
from shockwell.functions.regression import newey_west
from shockwell.functions.storage import written
from shockwell.operators.events import indicators, near_events
from shockwell.operators.har import har_design, recursive_path, with_raw_history
from shockwell.operators.nearest import nearest_in_time

FEATURES = ["forecast_log_variance", "log_daily", "log_weekly", "log_monthly", "pretrend"]


def forward_mean(x: str | Column, offset: int, window: int) -> Column:
    """Mean of x over the bars offset .. offset + window - 1 from here; all must be there."""
    return rolling(F.avg, x, offset, offset + window - 1)


def _lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("asset").agg((F.max("pos") + 1).alias("n"))


def _complete(rows: DataFrame, expected: int) -> DataFrame:
    """Rows of events of which every offset is valid."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("asset", "event_id"))).where(F.col("_n") == expected).drop("_n")


def _abnormal(rows: DataFrame, method: str) -> DataFrame:
    rows = rows.where("actual_variance > 0 and counterfactual_variance > 0").withColumn("abnormal_log_variance", F.ln(F.col("actual_variance") / F.col("counterfactual_variance")))
    return rows.withColumn("abnormal_excess_variance", F.expm1("abnormal_log_variance")).withColumn("method", F.lit(method))


def counterfactual_paths(diagnostics: DataFrame, events: DataFrame, window: int = 5, post: int = 30, stride: int = 1, smearing: bool = False, variance: str = "variance_proxy") -> DataFrame:
    """Mean variance of `window` bars from each offset on, against the recursive forecast from the bars before the event.

    Without `smearing` the path is the conditional median; bars without a positive variance_proxy count as missing: the
    history skips them, and a window that holds one is left out. With it the path is the mean over the bars of `variance` as
    they are: an event with a missing or nonpositive one among the 22 before it has no path, and a window is left out if one
    of its bars is missing or its mean isn't positive. An event counts only if all offsets do.
    """
    if min(window, post, stride) < 1:
        raise ValueError("window, post and stride must be positive")
    history = "raw_history" if smearing else "history"
    if smearing:
        raw = with_raw_history(diagnostics, variance).select("asset", "pos", "raw_history")
        events = events.drop("raw_history").join(raw, ["asset", "pos"])
    usable = events.join(_lengths(diagnostics), "asset").where((F.col("pos") >= 22) & (F.col("pos") + post + window < F.col("n")) & F.col(history).isNotNull() & F.col("har_const").isNotNull())
    paths = usable.withColumn("path", recursive_path(F.col(history), post + window + 1, smearing))
    offsets = paths.select("asset", "event_id", F.col("begin").alias("event_timestamp"), "direction", "shock_score", "pos", "path", F.explode(F.sequence(F.lit(1), F.lit(post), F.lit(stride))).alias("offset"))
    expected = F.aggregate(F.slice("path", F.col("offset") + 1, window), F.lit(0.0), lambda a, x: a + x) / window
    actual = diagnostics.select("asset", "pos", forward_mean(variance if smearing else "variance_proxy", 0, window).alias("actual_variance"))
    rows = offsets.withColumn("counterfactual_variance", expected).withColumn("pos", F.col("pos") + F.col("offset")).drop("path").join(actual, ["asset", "pos"]).drop("pos")
    return _complete(_abnormal(rows, "har_conditional_mean" if smearing else "har_conditional_median"), len(range(1, post + 1, stride)))


def event_features(diagnostics: DataFrame, returns: str = "close_return", window: int = 20, energy: str = "variance_proxy") -> DataFrame:
    """Forecast, lagged states and trend of each bar, all known before it; `energy` is the variance that scales the trend."""
    rows = har_design(diagnostics, "variance_proxy")
    total, energy = rolling(F.sum, returns, -window, -1), rolling(F.sum, clip(energy, low=0.0), -window, -1)
    return rows.withColumn("_t", total).withColumn("_e", energy).withColumn("pretrend", F.when(F.col("_e") > 0, F.col("_t") / F.sqrt("_e"))).drop("_t", "_e", "target")


def matched_controls(diagnostics: DataFrame, events: DataFrame, window: int = 5, post: int = 30, controls: int = 10, trend: int = 20, reach: int = 504, cap: float = 1.0, radius: int = 10, energy: str = "variance_proxy") -> DataFrame:
    """The `controls` calm bars nearest to each event in the features known before it, with a penalty for distance in time.

    Bars near any event never serve as controls. Bars within `reach` of the event are preferred; an event with fewer than
    `controls` of them uses all. Events meet candidates of their own asset only, and of those the ones that the penalty
    leaves a chance.
    """
    rows = event_features(diagnostics, window=trend, energy=energy).join(_lengths(diagnostics), "asset")
    sound = rows.dropna(subset=FEATURES).where(F.col("pos") <= F.col("n") - post - window)
    pool = sound.where(F.col("shock_score").isNotNull() & (F.col("shock_score") <= cap)).join(near_events(rows, events, radius, radius), ["asset", "pos"], "left_anti")
    group = Window.partitionBy("asset")
    pool = pool.withColumn("_size", F.count("*").over(group)).where(F.col("_size") >= controls)
    mids = pool.groupBy("asset").agg(*[median(f).alias(f"mid_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"std_{f}") for f in FEATURES])
    mads = pool.join(mids, "asset").groupBy("asset").agg(*[(MAD_SCALE * median(F.abs(F.col(f) - F.col(f"mid_{f}")))).alias(f"mad_{f}") for f in FEATURES])
    scales = mids.join(mads, "asset").select("asset", *[F.when(F.col(f"mad_{f}") > 0, F.col(f"mad_{f}")).when(F.col(f"std_{f}") > 0, F.col(f"std_{f}")).otherwise(1.0).alias(f"scale_{f}") for f in FEATURES])
    left = events.select("asset", "pos", "event_id", "direction").join(sound.select("asset", "pos", F.col("begin").alias("event_timestamp"), *[F.col(f).alias(f"event_{f}") for f in FEATURES]), ["asset", "pos"]).withColumnRenamed("pos", "event_position")
    right = pool.select("asset", F.col("pos").alias("control_position"), F.col("begin").alias("control_timestamp"), *[F.col(f).alias(f"control_{f}") for f in FEATURES])
    left = left.join(scales, "asset")
    square = sum((F.pow((F.col(f"event_{f}") - F.col(f"control_{f}")) / F.col(f"scale_{f}"), F.lit(2.0)) for f in FEATURES), F.lit(0.0))
    apart = 0.25 * F.abs(F.col("event_position") - F.col("control_position")) / max(reach, 1)
    near = nearest_in_time(left, right, ["asset"], "event_id", "event_position", "control_position", F.sqrt(square) + apart, 0.25 / max(reach, 1), controls, "control_position", reach=reach)
    ranked = near.withColumnRenamed("rank", "control_rank")
    names = [f"{side}_{f}" for side in ("event", "control") for f in FEATURES]
    return ranked.select("asset", "event_id", "event_timestamp", "event_position", "direction", "control_rank", "control_position", "control_timestamp", "distance", *names)


def matching_balance(matches: DataFrame) -> DataFrame:
    """Means of events and controls, standardised difference and mean distance, by feature."""
    rows = matches.select("asset", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"event_{f}").alias("e"), F.col(f"control_{f}").alias("c")) for f in FEATURES])))
    each = rows.groupBy("asset", "feature").agg(F.avg("e").alias("event_mean"), F.avg("c").alias("control_mean"), F.sqrt((F.var_samp("e") + F.var_samp("c")) / 2).alias("pooled"), F.avg(F.abs(F.col("e") - F.col("c"))).alias("mean_absolute_pair_difference"))
    return each.withColumn("standardized_mean_difference", F.when(F.col("pooled") > 0, (F.col("event_mean") - F.col("control_mean")) / F.col("pooled")).otherwise(0.0)).drop("pooled")


def matched_paths(diagnostics: DataFrame, events: DataFrame, matches: DataFrame, window: int = 5, post: int = 30, controls: int = 10, stride: int = 1) -> DataFrame:
    """Mean variance after each event against the geometric median of its controls at the same offset."""
    ahead = diagnostics.select("asset", "pos", forward_mean("variance_proxy", 0, window).alias("v")).where("v > 0")
    offsets = F.explode(F.sequence(F.lit(1), F.lit(post), F.lit(stride))).alias("offset")
    calm = matches.select("asset", "event_id", "control_position", offsets).withColumn("pos", F.col("control_position") + F.col("offset")).join(ahead, ["asset", "pos"])
    reference = calm.groupBy("asset", "event_id", "offset").agg(F.exp(median(F.ln("v"))).alias("counterfactual_variance"), F.count("*").alias("control_count")).where(F.col("control_count") >= max(3, controls // 2))
    own = events.select("asset", "event_id", F.col("begin").alias("event_timestamp"), "direction", "shock_score", "pos", offsets).withColumn("pos", F.col("pos") + F.col("offset")).join(ahead, ["asset", "pos"]).drop("pos").withColumnRenamed("v", "actual_variance")
    return _complete(_abnormal(own.join(reference, ["asset", "event_id", "offset"]), "matched_controls"), len(range(1, post + 1, stride)))


SIDES = {"negative": [1.0, 0.0], "positive": [0.0, 1.0], "difference": [1.0, -1.0]}


def local_projections(diagnostics: DataFrame, events: DataFrame, window: int = 5, post: int = 30, stride: int = 1, trend: int = 20, radius: int = 10, year_effects: bool = True, least: int = 400, energy: str = "variance_proxy") -> DataFrame:
    """For each horizon a regression of ln future variance on shock indicators and what was known before, with Newey-West
    errors of window - 1 or, farther out, offset + window - 2 lags. Bars near an event and unselected exceedances take no
    part; a horizon with fewer than `least` bars, or 8 events of a direction, has no row. Years have effects of their own
    (or all bars one constant). Horizons are fitted side by side, from sums."""
    bars = events.groupBy("asset").agg(F.first("threshold").alias("_bar"))
    rows = indicators(event_features(diagnostics, window=trend, energy=energy), events).join(bars, "asset")
    event = F.col("negative_event") + F.col("positive_event") > 0
    chosen = events.select("asset", "pos", F.lit(True).alias("_event"))
    near = near_events(rows, events, radius, radius).withColumn("_close", F.lit(True))
    rows = rows.join(near, ["asset", "pos"], "left").join(chosen, ["asset", "pos"], "left")
    rows = rows.withColumns({f"_t{k}": F.ln(forward_mean("variance_proxy", k, window) + EPSILON) for k in range(1, post + 1, stride)})
    rows = rows.where(F.coalesce("_event", F.lit(False)) | (F.col("_close").isNull() & ~F.coalesce(F.col("shock_score") >= F.col("_bar"), F.lit(False))) | event)
    targets = F.inline(F.array(*[F.struct(F.lit(k).alias("offset"), F.col(f"_t{k}").alias("target")) for k in range(1, post + 1, stride)]))
    design = rows.select("asset", "pos", F.year("begin").alias("year"), "negative_event", "positive_event", *FEATURES, targets).dropna()
    design = written(design, "projections")  # read for the counts, the sums and the residuals
    by, names = ["asset", "offset"], ["negative_event", "positive_event", *FEATURES]
    counts = design.groupBy(*by).agg(F.count("*").alias("nobs"), *[F.sum(f"{d}_event").cast("long").alias(f"{d}_events") for d in ("negative", "positive")])
    counts = counts.where((F.col("nobs") >= least) & (F.col("negative_events") >= 8) & (F.col("positive_events") >= 8))
    contrasts = {side: [*w, *[0.0] * len(FEATURES)] for side, w in SIDES.items()}
    lags = F.greatest(F.lit(window - 1), F.col("offset") + window - 2, F.lit(1))
    fits = newey_west(design.join(counts.select(*by), by), by, "pos", "target", names, lags, contrasts, absorb=["year"] if year_effects else [])
    one = lambda side, c: F.max(F.when(F.col("term") == side, F.col(c)))
    told = {(f"{side}_{c}" if c != "estimate" or side != "difference" else side): one(side, c) for side in SIDES for c in ("estimate", "std_error", "ci_low", "ci_high", "p_value")}
    wide = fits.groupBy(*by).agg(*[x.alias(c) for c, x in told.items()], F.first("r_squared").alias("r_squared"))
    return counts.join(wide, by)


def projection_summary(projections: DataFrame) -> DataFrame:
    """Projections as excess variance by direction, shaped like the other methods' summaries."""
    sides = F.inline(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"{d}_estimate").alias("e"), F.col(f"{d}_ci_low").alias("l"), F.col(f"{d}_ci_high").alias("h"), F.col(f"{d}_events").alias("count")) for d in ("negative", "positive")]))
    rows = projections.select("asset", "offset", sides)
    names = {"mean": "e", "median": "e", "q25": "l", "q75": "h", "bootstrap_ci_low": "l", "bootstrap_ci_high": "h"}
    return rows.select("asset", "direction", "offset", *[F.expm1(c).alias(n) for n, c in names.items()], "count", F.lit("local_projection").alias("method"))


def resampled(rows: DataFrame, by: list[str], samples: int, seed: int) -> DataFrame:
    """(by, sample, event_id): for each sample as many events as the group has, drawn with replacement by hashes.

    A draw depends on seed, sample and turn alone, so lost tasks draw the same again.
    """
    events = rows.select(*by, "event_id").distinct()
    numbered = events.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy("event_id")) - 1)
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("size"))
    turns = sizes.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("turn", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int"))))
    draws = turns.withColumn("index", hash_draw(seed, "sample", "turn") % F.col("size"))
    return draws.join(numbered, [*by, "index"]).select(*by, "sample", "event_id")


def multiplicities(rows: DataFrame, by: list[str], samples: int, seed: int) -> DataFrame:
    """(by, sample, event_id, times): how often each event was drawn into each sample; events not drawn have no row."""
    return resampled(rows, by, samples, seed).groupBy(*by, "sample", "event_id").agg(F.count("*").alias("times"))


def weighted_median(x: str | Column) -> Column:
    """Median of x, each value as often as `times` says."""
    return F.percentile(x, F.lit(0.5), F.col("times"))


def weighted_mean(x: str | Column) -> Column:
    """Mean of x, each value as often as `times` says; nulls count for nothing."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(x * F.col("times")) / F.sum(F.when(x.isNotNull(), F.col("times")))


def bootstrap_interval(rows: DataFrame, value: str, by: list[str], at: list[str], statistic, samples: int, seed: int) -> DataFrame:
    """(by, at, bootstrap_ci_low, bootstrap_ci_high): 95 % interval of a statistic, weighted by `times`, over resampled events.

    A sample is its events' multiplicities, which meet each event's values as one array: the values spread out only after
    the join, into the partial aggregation of the task that has them.
    """
    packed = rows.groupBy(*by, "event_id").agg(F.collect_list(F.struct(*at, value)).alias("_values"))
    drawn = multiplicities(rows, by, samples, seed).join(packed, [*by, "event_id"]).select(*by, "sample", "times", F.inline("_values"))
    each = drawn.groupBy(*by, *at, "sample").agg(statistic(value).alias("s"))
    return each.groupBy(*by, *at).agg(quantile("s", 0.025).alias("bootstrap_ci_low"), quantile("s", 0.975).alias("bootstrap_ci_high"))


def response_summary(paths: DataFrame, samples: int = 500, seed: int = 1729) -> DataFrame:
    """Mean, median, quartiles, count and event-level bootstrap interval of the excess, by direction and offset."""
    if samples < 100:
        raise ValueError("samples must be at least 100")
    v = "abnormal_excess_variance"
    paths = written(paths.select("asset", "direction", "event_id", "offset", "method", v), "responses")  # read for the counts and the draws
    stats = paths.groupBy("asset", "direction", "offset").agg(F.avg(v).alias("mean"), median(v).alias("median"), quantile(v, 0.25).alias("q25"), quantile(v, 0.75).alias("q75"), F.count("*").alias("count"), F.first("method").alias("method"))
    return stats.join(bootstrap_interval(paths, v, ["asset", "direction"], ["offset"], weighted_median, samples, seed), ["asset", "direction", "offset"])


def event_horizon_values(paths: DataFrame, start: int, end: int) -> DataFrame:
    rows = paths.where(F.col("offset").between(start, end))
    return rows.groupBy("asset", "direction", "event_id").agg(F.expm1(F.avg("abnormal_log_variance")).alias("value"))


def horizon_comparisons(paths: DataFrame, horizons: tuple[tuple[int, int], ...] = ((1, 5), (6, 10), (11, 20)), samples: int = 2000, seed: int = 31415) -> DataFrame:
    """Median excess of negative minus that of positive shocks by horizon, with a bootstrap interval and p value."""
    spans = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("horizon"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in horizons])
    rows = paths.where("direction in ('negative', 'positive')").select("asset", "direction", "event_id", "offset", "abnormal_log_variance", F.inline(spans)).where("offset between a and b")
    values = rows.groupBy("asset", "horizon", "direction", "event_id").agg(F.expm1(F.avg("abnormal_log_variance")).alias("value"))
    values = written(values, "horizons")  # read for the medians and the draws
    by, key = ["asset", "horizon"], ["asset", "horizon", "direction"]
    side = lambda d: F.when(F.col("direction") == d, F.col("value"))
    drawn = multiplicities(values, key, samples, seed).join(values, [*key, "event_id"])
    mids = drawn.groupBy(*by, "sample").agg(weighted_median(side("negative")).alias("n"), weighted_median(side("positive")).alias("p"))
    gaps = mids.withColumn("d", F.col("n") - F.col("p")).groupBy(*by).agg(quantile("d", 0.025).alias("difference_ci_low"), quantile("d", 0.975).alias("difference_ci_high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int")))).alias("bootstrap_p_value"))
    stats = values.groupBy(*by).agg(median(side("negative")).alias("negative_median_excess"), median(side("positive")).alias("positive_median_excess"), F.count(side("negative")).alias("negative_events"), F.count(side("positive")).alias("positive_events")).where("negative_events >= 3 and positive_events >= 3")
    return stats.join(gaps, by).withColumn("negative_minus_positive", F.col("negative_median_excess") - F.col("positive_median_excess"))


def early_summary(summaries: DataFrame, early_end: int = 5) -> DataFrame:
    """Mean early excess, whether any early interval is above 0, and the least count, by method and direction."""
    rows = summaries.where(F.col("offset") <= early_end)
    return rows.groupBy("asset", "method", "direction").agg(F.avg("median").alias("early_mean_excess"), F.bool_or(F.col("bootstrap_ci_low") > 0).alias("positive_support"), F.min("count").alias("minimum_events"))


def consensus(summary: DataFrame, which: str = "negative") -> DataFrame:
    """Whether decay laws may be fitted: local projections agree, two methods do, and one has support."""
    rows = summary.where(F.col("direction") == which)
    up = F.col("early_mean_excess") > 0
    each = rows.groupBy("asset").agg(F.max(F.when(F.col("method") == "local_projection", up.cast("int"))).alias("lp"), F.count_if(up).alias("methods_positive"), F.count_if(F.col("positive_support")).alias("methods_supported"))
    lp = F.coalesce(F.col("lp") == 1, F.lit(False))
    reason = F.when(~lp, "local projections show no early excess").when(F.col("methods_positive") < 2, "fewer than two methods show an early excess").when(F.col("methods_supported") < 1, "no method has support").otherwise("methods agree")
    return each.select("asset", (lp & (F.col("methods_positive") >= 2) & (F.col("methods_supported") >= 1)).alias("allowed"), "methods_positive", "methods_supported", reason.alias("reason"))


def aftershock_rates(diagnostics: DataFrame, events: DataFrame, horizon: int = 30) -> DataFrame:
    """Share of later scores that reach the events' own threshold, by offset."""
    scored = diagnostics.where("shock_score is not null").select("asset", "pos", "shock_score")
    later = events.select("asset", "pos", "threshold", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("offset")).withColumn("pos", F.col("pos") + F.col("offset")).join(scored, ["asset", "pos"])
    hit = F.col("shock_score") >= F.col("threshold")
    return later.groupBy("asset", "offset").agg(F.avg(hit.cast("double")).alias("rate"), F.count_if(hit).alias("count"), F.count("*").alias("exposed_events"))


def aftershocks(diagnostics: DataFrame, events: DataFrame, horizon: int = 30, q: float = 0.9) -> DataFrame:
    """Share of events with a score over the asset's q-quantile at each offset, against the share over all bars."""
    scored = diagnostics.where("shock_score is not null").select("asset", "pos", "shock_score")
    bars = scored.groupBy("asset").agg(quantile("shock_score", q).alias("aftershock_threshold"))
    base = scored.join(bars, "asset").groupBy("asset").agg(F.avg((F.col("shock_score") >= F.col("aftershock_threshold")).cast("double")).alias("baseline_rate"), F.first("aftershock_threshold").alias("aftershock_threshold"))
    later = events.select("asset", "event_id", "pos", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("offset")).withColumn("pos", F.col("pos") + F.col("offset")).join(scored, ["asset", "pos"]).join(bars, "asset")
    hit = F.col("shock_score") >= F.col("aftershock_threshold")
    rates = later.groupBy("asset", "offset").agg(F.avg(hit.cast("double")).alias("rate"), F.count_if(hit).alias("count"), F.count("*").alias("exposed_events")).join(base, "asset")
    return rates.withColumn("excess_rate", F.col("rate") - F.col("baseline_rate")).withColumn("rate_ratio", divide("rate", "baseline_rate"))


def event_study(df: DataFrame, events: DataFrame, level: str, pre: int = 20, post: int = 60) -> DataFrame:
    """Level around each event, less the median before it, in units of the event's own excess."""
    base = df.withColumn("baseline", rolling(median, level, -pre, -1, least=1)).join(_lengths(df), "asset")
    own = events.select("asset", "event_id", "pos").join(base.select("asset", "pos", "n", "baseline", F.col(level).alias("_peak")), ["asset", "pos"])
    own = own.where((F.col("pos") >= pre) & (F.col("pos") + post < F.col("n")) & (F.col("_peak") - F.col("baseline") > 0))
    rows = own.withColumn("offset", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn("event_position", F.col("pos")).withColumn("pos", F.col("pos") + F.col("offset"))
    rows = rows.join(df.select("asset", "pos", F.col(level).alias("volatility")), ["asset", "pos"])
    return rows.select("asset", "event_id", "event_position", "offset", "volatility", "baseline", ((F.col("volatility") - F.col("baseline")) / (F.col("_peak") - F.col("baseline"))).alias("normalized_excess"))


def forward_study(df: DataFrame, events: DataFrame, returns: str, base: int = 60, window: int = 5, post: int = 60, stride: int = 1, annual: float = ANNUAL) -> DataFrame:
    """Volatility of the bars after an event (itself left out) over that before it; offsets without data are left out."""
    r2 = F.col(returns) * F.col(returns)
    rows = df.select("asset", "pos", F.sqrt(annual * rolling(F.avg, r2, -base, -1)).alias("baseline"), F.sqrt(annual * forward_mean(r2, 1, window)).alias("forward"))
    own = events.select("asset", "event_id", "pos").join(rows.select("asset", "pos", "baseline"), ["asset", "pos"]).join(_lengths(df), "asset")
    own = own.where((F.col("baseline") > 0) & (F.col("pos") + post + window < F.col("n")))
    later = own.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(post), F.lit(stride)))).withColumn("pos", F.col("pos") + F.col("offset")).join(rows.select("asset", "pos", F.col("forward").alias("forward_volatility")), ["asset", "pos"])
    return later.where("forward_volatility is not null").select("asset", "event_id", "offset", "baseline", "forward_volatility", (F.col("forward_volatility") / F.col("baseline") - 1).alias("excess_ratio"))


def offset_summary(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("asset", "offset").agg(F.avg(value).alias("mean"), median(value).alias("median"), quantile(value, 0.25).alias("q25"), quantile(value, 0.75).alias("q75"), F.count(value).alias("count"))
