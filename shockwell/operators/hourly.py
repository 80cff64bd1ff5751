"""Hour-of-day standardisation of intraday returns, their moments, price mobility, and moment shocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.columns import MAD_QUANTILE, average_rank, clip, divide, median, quantile, quantile_bucket, rolling, series, trailing
from shockwell.functions.sketches import sketched_thresholds
from shockwell.operators.quality import prepared_hourly
from shockwell.operators.events import greedy_in_time, near_events
from shockwell.operators.nearest import nearest_in_time


def _hours():
    return Window.partitionBy("asset", "hour").orderBy("pos")


def prepared_asset(candles: DataFrame, first_hour: int = 10, last_hour: int = 18, window: int = 252, least: int = 80) -> DataFrame:
    """Hourly candles, cleaned and dated as `prepared_hourly` does, with their standardised returns."""
    return standardised(prepared_hourly(candles, first_hour, last_hour), window, least)


def standardised(rows: DataFrame, window: int = 252, least: int = 80, bound: float = 8.0, strict_past: bool = False, sketch: int | None = None) -> DataFrame:
    """Returns over a scale known before them, by clock hour: a rolling MAD, then a rolling root mean square.

    Bars without enough history take the hour's MAD over all bars, which looks ahead; `strict_past` leaves them null.
    A scale of 0 gives no standardised value. With `sketch`, a size, the hour's median over all bars comes from a sketch.
    """
    df = rows.withColumn("absolute_return", F.abs("log_return_oc"))
    past = rolling(median, "absolute_return", -window, -1, least, _hours()) / MAD_QUANTILE
    whole = median("absolute_return").over(Window.partitionBy("asset", "hour"))
    if sketch is not None:
        df = df.join(sketched_thresholds(df, "absolute_return", ["asset", "hour"], 0.5, sketch).select("asset", "hour", F.col("threshold").alias("_whole")), ["asset", "hour"], "left")
        whole = F.col("_whole")
    rest = F.greatest(whole / MAD_QUANTILE, F.lit(1e-8))
    df = df.withColumn("scale_mad", past if strict_past else F.coalesce(past, rest)).drop("_whole")
    df = df.withColumn("preliminary_z", divide("log_return_oc", "scale_mad"))
    df = df.withColumn("_square", F.pow(clip("preliminary_z", -5.0, 5.0), F.lit(2.0)))
    df = df.withColumn("rms_correction", clip(F.coalesce(F.sqrt(rolling(F.avg, "_square", -window, -1, least, _hours())), F.lit(1.0)), 0.5, 3.0)).drop("_square")
    df = df.withColumn("conditional_scale", F.col("scale_mad") * F.col("rms_correction"))
    df = df.withColumn("z_return", clip(divide("log_return_oc", "conditional_scale"), -bound, bound))
    z = F.col("z_return")
    return df.withColumns({"m2_instant": z * z, "m2_clipped": clip(z * z, high=36.0), "m3_instant": F.pow(clip(z, -6.0, 6.0), F.lit(3.0)), "signed_m2": z * F.abs(z)})


def standardised_moments(rows: DataFrame, window: int) -> DataFrame:
    """Rolling moments of values that are each centred on their own trailing mean; half a window is enough."""
    least = max(10, window // 2)
    z = F.col("z_return")
    df = rows.withColumn("_c", z - trailing(F.avg, "z_return", window, least))
    half = lambda sign: trailing(F.avg, F.when(z * sign > 0, z * z).otherwise(0.0), window, least)
    df = df.withColumns({"m2": trailing(F.avg, F.pow("_c", F.lit(2.0)), window, least), "m3": trailing(F.avg, F.pow("_c", F.lit(3.0)), window, least), "signed_m2_mean": trailing(F.avg, "signed_m2", window, least), "_down": half(-1.0), "_up": half(1.0)})
    return df.withColumn("skewness", F.when(F.col("m2") > 0, F.col("m3") / F.pow("m2", F.lit(1.5)))).withColumn("downside_share", F.when(F.col("_down") + F.col("_up") > 0, F.col("_down") / (F.col("_down") + F.col("_up")))).drop("_c", "_down", "_up")


def _robust_summary(rows: DataFrame, x: str, by: list[str], least: int) -> DataFrame:
    """observations, mean, standard_deviation, bias-corrected skewness and m3 of robustly scaled, winsorised values."""
    group = Window.partitionBy(*by)
    df = rows.where(F.col(x).isNotNull()).withColumn("_n", F.count("*").over(group)).where(F.col("_n") >= least)
    df = df.withColumn("_d", F.col(x) - median(x).over(group))
    df = df.withColumn("_dm", F.col("_d") - median("_d").over(group)).withColumn("_std", F.stddev_pop("_d").over(group))
    df = df.withColumn("_mad", median(F.abs("_dm")).over(group))
    scale = F.when(F.col("_mad") > 1e-12, F.col("_mad") / MAD_QUANTILE).when(F.col("_std") > 1e-12, F.col("_std")).otherwise(1.0)
    df = df.withColumn("_s", F.col("_d") / scale)
    df = df.withColumn("_low", quantile("_s", 0.005).over(group)).withColumn("_high", quantile("_s", 0.995).over(group))
    df = df.withColumn("_w", F.greatest(F.least("_s", "_high"), F.col("_low")))
    df = df.withColumn("_e", F.col("_w") - F.avg("_w").over(group))
    n, m2, m3 = F.count("*"), F.avg(F.pow("_e", F.lit(2.0))), F.avg(F.pow("_e", F.lit(3.0)))
    g1 = F.when(m2 > 0, m3 / F.pow(m2, F.lit(1.5))) * F.sqrt(n * (n - 1)) / (n - 2)
    return df.groupBy(*by).agg(n.alias("observations"), F.avg("_w").alias("mean"), F.sqrt(m2).alias("standard_deviation"), g1.alias("skewness"), m3.alias("m3"))


def session_moments(rows: DataFrame, least: int = 40) -> DataFrame:
    return _robust_summary(rows, "log_return_oc", ["asset", "hour"], least)


def overnight_moments(rows: DataFrame, least: int = 20, excluded_year: int = 2022) -> DataFrame:
    """Moments of the return from a day's last close to the next day's first open, over all days and three filters."""
    days = rows.groupBy("asset", "date").agg(F.min_by("open", "pos").alias("first_open"), F.max_by("close", "pos").alias("last_close"))
    before = F.lag("last_close").over(Window.partitionBy("asset").orderBy("date"))
    days = days.withColumn("overnight_return", F.ln(F.col("first_open") / before))
    year, small = F.year("date") != excluded_year, F.abs("overnight_return") < F.ln(F.lit(1.2))
    labels = F.array_compact(F.array(F.lit("all"), F.when(year, "exclude_year"), F.when(small, "absolute_gap_below_20pct"), F.when(year & small, "exclude_year_and_20pct")))
    return _robust_summary(days.withColumn("filter", F.explode(labels)), "overnight_return", ["asset", "filter"], least)


def price_bins(rows: DataFrame, bins: int = 8, least: int = 40, least_year: int = 400) -> DataFrame:
    """Spread of hour-adjusted price increments by year and price bucket."""
    df = rows.where("regular_session").withColumn("_a", F.abs("log_return_oc"))
    df = df.withColumn("_all", median("_a").over(Window.partitionBy("asset"))).withColumn("_hour", median("_a").over(Window.partitionBy("asset", "hour")))
    df = df.withColumn("_x", F.col("price_increment") / F.when(F.col("_all") > 0, F.greatest(F.col("_hour") / F.col("_all"), F.lit(0.2))).otherwise(1.0))
    year = Window.partitionBy("asset", "year")
    df = df.withColumn("_n", F.count("*").over(year)).where(F.col("_n") >= max(least_year, bins * least))
    df = df.withColumn("_low", quantile("_x", 0.005).over(year)).withColumn("_high", quantile("_x", 0.995).over(year)).where(F.col("_x").between(F.col("_low"), F.col("_high")))
    df = df.withColumn("bucket", quantile_bucket("price", bins, "asset", "year"))
    df = df.withColumn("_e", F.col("_x") - F.avg("_x").over(Window.partitionBy("asset", "year", "bucket")))
    m2, m3 = F.avg(F.pow("_e", F.lit(2.0))), F.avg(F.pow("_e", F.lit(3.0)))
    out = df.groupBy("asset", "year", "bucket").agg(F.avg("price").alias("price"), F.count("*").alias("observations"), F.sqrt(m2).alias("mobility"), m2.alias("m2_price"), m3.alias("m3_price"), F.when(m2 > 0, m3 / F.pow(m2, F.lit(1.5))).alias("skew_price"))
    return out.where(F.col("observations") >= least)


MODELS = ("constant", "proportional", "affine")


def _mobility_parameters(sums: dict[str, Column]) -> Column:
    """(a, b) of each model from weighted sums: non-negative least squares in closed form."""
    w, x, y, xx, xy = (sums[k] for k in ("w", "x", "y", "xx", "xy"))
    det = w * xx - x * x
    b = F.when(det > 0, (w * xy - x * y) / det)
    a = F.when(det > 0, (y * xx - x * xy) / det)
    only_a, only_b = F.greatest(y / w, F.lit(0.0)), F.greatest(xy / xx, F.lit(0.0))
    loss = lambda p, q: p * p * w + q * q * xx + 2 * p * q * x - 2 * p * y - 2 * q * xy
    inner = (a >= 0) & (b >= 0)
    better_b = loss(F.lit(0.0), only_b) <= loss(only_a, F.lit(0.0))
    affine_a = F.when(inner, a).when(better_b, 0.0).otherwise(only_a)
    affine_b = F.when(inner, b).when(better_b, only_b).otherwise(0.0)
    rows = [("constant", y / w, F.lit(0.0)), ("proportional", F.lit(0.0), only_b), ("affine", affine_a, affine_b)]
    return F.inline(F.array(*[F.struct(F.lit(m).alias("model"), p.cast("double").alias("a"), q.cast("double").alias("b")) for m, p, q in rows]))


def _weighted(bins: DataFrame) -> DataFrame:
    w = F.col("observations").cast("double")
    return bins.withColumns({"_w": w, "_x": w * F.col("price"), "_y": w * F.col("mobility"), "_xx": w * F.col("price") * F.col("price"), "_xy": w * F.col("price") * F.col("mobility")})


def fit_mobility(bins: DataFrame) -> DataFrame:
    """(asset, model, a, b, r_squared, rmse, sample_size): mobility = a + b * price, weighted by observations."""
    rows = _weighted(bins)
    sums = rows.groupBy("asset").agg(*[F.sum(f"_{k}").alias(k) for k in ("w", "x", "y", "xx", "xy")])
    fits = sums.select("asset", _mobility_parameters({k: F.col(k) for k in ("w", "x", "y", "xx", "xy")}))
    errors = rows.join(fits, "asset").withColumn("_e", F.col("mobility") - F.col("a") - F.col("b") * F.col("price")).withColumn("_m", F.sum("_y").over(Window.partitionBy("asset", "model")) / F.sum("_w").over(Window.partitionBy("asset", "model")))
    sse, total = F.sum(F.col("_w") * F.col("_e") * F.col("_e")), F.sum(F.col("_w") * F.pow(F.col("mobility") - F.col("_m"), F.lit(2.0)))
    return errors.groupBy("asset", "model", "a", "b").agg(F.when(total > 0, 1 - sse / total).alias("r_squared"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.count("*").alias("sample_size"))


def cross_validate_mobility(bins: DataFrame, least_train: int = 12, least_test: int = 3) -> DataFrame:
    """Each year predicted from all others. Weighted sums are additive: all years' sums less the year's own."""
    rows = _weighted(bins)
    keys = ("w", "x", "y", "xx", "xy")
    own = rows.groupBy("asset", "year").agg(*[F.sum(f"_{k}").alias(k) for k in keys], F.count("*").alias("n"))
    group = Window.partitionBy("asset")
    rest = own.select("asset", "year", *[(F.sum(k).over(group) - F.col(k)).alias(k) for k in keys], (F.sum("n").over(group) - F.col("n")).alias("train"), F.col("n").alias("test"))
    fits = rest.where((F.col("train") >= least_train) & (F.col("test") >= least_test)).select("asset", "year", _mobility_parameters({k: F.col(k) for k in keys}))
    errors = rows.join(fits, ["asset", "year"]).withColumn("_e", F.col("mobility") - F.col("a") - F.col("b") * F.col("price"))
    folds = errors.groupBy("asset", "year", "model").agg((F.sqrt(F.sum(F.col("_w") * F.col("_e") * F.col("_e")) / F.sum("_w")) / (F.sum("_y") / F.sum("_w"))).alias("error"))
    each = folds.groupBy("asset", "model").agg(F.avg("error").alias("mean"), median("error").alias("median"), F.stddev_samp("error").alias("std"), F.count("*").alias("years"))
    first = F.row_number().over(Window.partitionBy("asset").orderBy(F.round("mean", 9), "model"))
    return each.withColumn("winner", first == 1)


def affine_skewness(b: Column | float, horizon: Column | int) -> Column:
    """Skewness over `horizon` steps of a price whose mobility grows with it."""
    g = F.exp((b if isinstance(b, Column) else F.lit(b)) ** 2 * horizon)
    return F.when((b if isinstance(b, Column) else F.lit(b)) > 1e-12, (g + 2) * F.sqrt(g - 1)).otherwise(0.0)


def affine_horizon_test(rows: DataFrame, fits: DataFrame, horizons: tuple[int, ...] = (1, 2, 4, 6, 8), least: int = 50) -> DataFrame:
    """(asset, horizon_hours, observations, predicted_affine_skewness, observed_skewness): skewness of price increments
    over whole hours of a day in units of the affine law's conditional deviation, against the law's own.

    `fits` holds each asset's affine a and b. Increments run from a regular bar's open to the close `horizon` - 1 bars on,
    which must be the same day and as many hours later. Residuals are winsorised at half a percent.
    """
    work = rows.where("regular_session")
    order = Window.partitionBy("asset").orderBy("begin")
    ends = [F.struct(F.lit(h).alias("horizon_hours"), F.lead("close", h - 1).over(order).alias("end_close"), F.lead("begin", h - 1).over(order).alias("end")) for h in horizons]
    each = work.select("asset", "begin", "open", "price", F.array(*ends).alias("ends")).select("asset", "begin", "open", "price", F.inline("ends"))
    later = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))
    each = each.where((later == (F.col("horizon_hours") - 1) * F.lit(3_600_000_000).cast("long")) & (F.to_date("end") == F.to_date("begin")))
    each = each.join(fits.where("model = 'affine'").select("asset", "a", "b"), "asset")
    mobility, h = F.col("a") + F.col("b") * F.col("price"), F.col("horizon_hours")
    spread = F.when(F.col("b") > 1e-12, mobility / F.col("b") * F.sqrt(F.exp(F.col("b") * F.col("b") * h) - 1)).otherwise(mobility * F.sqrt(h))
    each = each.withColumn("r", divide(F.col("end_close") - F.col("open"), spread)).where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < float("inf")))
    by = ["asset", "horizon_hours"]
    ends = each.groupBy(*by).agg(quantile("r", 0.005).alias("low"), quantile("r", 0.995).alias("high"), F.count("*").alias("observations")).where(F.col("observations") >= least)
    kept = each.join(ends, by).withColumn("w", F.least(F.greatest("r", "low"), "high"))
    n = F.col("observations")
    told = kept.groupBy(*by, "b", "observations").agg(F.skewness("w").alias("g")).withColumn("observed_skewness", F.col("g") * F.sqrt(n * (n - 1)) / (n - 2))
    return told.select(*by, "observations", affine_skewness(F.col("b"), h).alias("predicted_affine_skewness"), "observed_skewness")


def moment_shocks(rows: DataFrame, q: float = 0.99, cooldown: int = 12, before: int = 12, ahead: int = 24, synchrony: DataFrame | None = None, wide: float = 0.4, isolated: float = 0.2, least: int = 48) -> DataFrame:
    """Large standardised returns, taken in the order of time, by how hot the bars before were and how wide the market moved."""
    work = rows.where("regular_session").withColumn("pos", (F.row_number().over(Window.partitionBy("asset").orderBy("begin")) - 1).cast("int"))
    work = work.withColumn("_abs", F.abs("z_return")).withColumn("precursor_m2", rolling(F.avg, "m2_clipped", -before, -1, 1)).withColumn("far_m2", rolling(F.avg, "m2_clipped", -48, -25, 1))
    hits = greedy_in_time(work, "_abs", q, cooldown, max(least, before), ahead)
    n = F.count("*").over(Window.partitionBy("asset"))
    hits = hits.withColumn("precursor_rank", average_rank("precursor_m2", "asset") / n)
    hits = hits.withColumn("direction", F.when(F.col("z_return") < 0, "negative").otherwise("positive"))
    hits = hits.withColumn("heating_class", F.when(F.col("precursor_rank") <= 0.4, "abrupt-like").when(F.col("precursor_rank") >= 0.6, "preheated-like").otherwise("intermediate"))
    if synchrony is None:
        return hits.withColumns({"synchrony": F.lit(None).cast("double"), "synchrony_class": F.lit("not available"), "process_class": F.col("heating_class")})
    hits = hits.join(synchrony.select("begin", "synchrony"), "begin", "left")
    hits = hits.withColumn("synchrony_class", F.when(F.col("synchrony") >= wide, "market-wide").when(F.col("synchrony") <= isolated, "isolated").otherwise("intermediate"))
    external = (F.col("heating_class") == "abrupt-like") & (F.col("synchrony_class") == "market-wide")
    internal = (F.col("heating_class") == "preheated-like") & (F.col("synchrony_class") == "isolated")
    return hits.withColumn("process_class", F.when(external, "external-like").when(internal, "internal-like").otherwise("other"))


def matched_moments(rows: DataFrame, shocks: DataFrame, controls: int = 8, pre: int = 12, post: int = 24, radius: int = 24, least: int = 48) -> tuple[DataFrame, DataFrame]:
    """(paths, matches): each shock's moments around it, less those of calm bars of the same hour with a like history.
    Controls are the nearest by an exact search that reads only the bars which the penalty for years apart leaves a chance."""
    work = rows.where("regular_session").withColumn("pos", (F.row_number().over(Window.partitionBy("asset").orderBy("begin")) - 1).cast("int"))
    work = work.withColumn("_pre", rolling(F.avg, "m2_clipped", -12, -1, 8)).withColumn("_far", rolling(F.avg, "m2_clipped", -48, -25, 16)).withColumn("_sum", rolling(F.sum, "log_return_oc", -12, -1, 8))
    work = work.withColumns({"f1": F.log1p(clip("_pre", low=0.0)), "f2": F.log1p(clip("_far", low=0.0)), "f3": F.col("_sum") / F.sqrt(clip("_far", low=0.1))})
    work = work.withColumn("_base", rolling(F.avg, "m2_clipped", -pre, -1, 1)).withColumn("_count", F.count("m2_clipped").over(series().rowsBetween(-pre, -1))).withColumn("_n", F.count("*").over(Window.partitionBy("asset"))).withColumn("_cap", quantile(F.abs("z_return"), 0.95).over(Window.partitionBy("asset")))
    names = ["f1", "f2", "f3"]
    pool = work.where((F.abs("z_return") < F.col("_cap")) & (F.col("pos") >= max(least, pre)) & (F.col("pos") < F.col("_n") - post)).dropna(subset=names).join(near_events(work, shocks, radius, post), ["asset", "pos"], "left_anti")
    mids = pool.groupBy("asset").agg(*[median(f).alias(f"mid_{f}") for f in names])
    spans = pool.join(mids, "asset").groupBy("asset").agg(*[median(F.abs(F.col(f) - F.col(f"mid_{f}"))).alias(f"mad_{f}") for f in names])
    own = shocks.select("asset", "event_id", "pos", "direction", "process_class").join(work.select("asset", "pos", "hour", "begin", *names), ["asset", "pos"]).dropna(subset=names)
    own = own.select("asset", "hour", "event_id", F.col("pos").alias("event_position"), F.col("begin").alias("event_begin"), "direction", "process_class", *[F.col(f).alias(f"e_{f}") for f in names])
    right = pool.select("asset", "hour", F.col("pos").alias("control_position"), F.col("begin").alias("control_begin"), "_base", "_count", *[F.col(f).alias(f"c_{f}") for f in names])
    square = sum((F.pow((F.col(f"e_{f}") - F.col(f"c_{f}")) / F.when(F.col(f"mad_{f}") != 0, F.col(f"mad_{f}")).otherwise(1.0), F.lit(2.0)) for f in names), F.lit(0.0))
    days = F.abs(F.timestamp_diff("MICROSECOND", "control_begin", "event_begin")) / 86_400_000_000.0
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000.0
    own, right = own.join(spans, "asset").withColumn("event_day", day("event_begin")), right.withColumn("control_day", day("control_begin"))
    event = Window.partitionBy("asset", "event_id")
    ranked = nearest_in_time(own, right, ["asset", "hour"], "event_id", "event_day", "control_day", square + 0.03 * days / 365.0, 0.03 / 365.0, controls, "control_position", stretch=8 * controls, width=365.0)
    ranked = ranked.withColumn("_k", F.count("*").over(event)).where(F.col("_k") >= max(3, controls // 2))
    base = F.greatest(F.sum(F.col("_base") * F.col("_count")) / F.sum("_count"), F.lit(0.2))
    matches = ranked.groupBy("asset", "event_id", "event_position", "direction", "process_class").agg(F.count("*").alias("controls"), F.avg("distance").alias("mean_distance"), base.alias("baseline"))
    offsets = F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("offset")
    values = work.select("asset", "pos", "m2_clipped", "m3_instant")
    calm = ranked.select("asset", "event_id", "control_position", offsets).withColumn("pos", F.col("control_position") + F.col("offset")).join(values, ["asset", "pos"]).groupBy("asset", "event_id", "offset").agg(median("m2_clipped").alias("c2"), F.avg("m3_instant").alias("c3"))
    paths = matches.select("asset", "event_id", "event_position", "direction", "process_class", "baseline", offsets).withColumn("pos", F.col("event_position") + F.col("offset")).join(values, ["asset", "pos"]).join(calm, ["asset", "event_id", "offset"])
    out = paths.select("asset", "event_id", "direction", "process_class", "offset", ((F.col("m2_clipped") - F.col("c2")) / F.col("baseline")).alias("abnormal_m2"), ((F.col("m3_instant") - F.col("c3")) / F.pow("baseline", F.lit(1.5))).alias("abnormal_m3"))
    return out, matches


def panel_synchrony(rows: DataFrame, q: float = 0.95) -> DataFrame:
    """(begin, synchrony): share of all assets whose |z| exceeds its own q-quantile; a missing asset doesn't."""
    bars = rows.groupBy("asset").agg(quantile(F.abs("z_return"), q).alias("_bar"))
    assets = rows.agg(F.count_distinct("asset").alias("_assets"))
    hit = F.count_if(F.abs("z_return") > F.col("_bar"))
    return rows.join(bars, "asset").groupBy("begin").agg(hit.alias("_h")).crossJoin(F.broadcast(assets)).select("begin", (F.col("_h") / F.col("_assets")).alias("synchrony"))  # the right side is one row


def market_moments(rows: DataFrame, q: float = 0.95) -> DataFrame:
    """Median second and mean third moment over assets at each time, share of falling ones, and synchrony."""
    z = rows.withColumn("z_return", clip("z_return", -6.0, 6.0))
    assets = z.agg(F.count_distinct("asset").alias("_assets"))
    each = z.groupBy("begin").agg(median(F.pow("z_return", F.lit(2.0))).alias("market_m2"), F.avg(F.pow("z_return", F.lit(3.0))).alias("market_m3"), F.count_if(F.col("z_return") < 0).alias("_neg"), F.count("z_return").alias("assets"))
    each = each.crossJoin(F.broadcast(assets)).withColumn("negative_share", F.col("_neg") / F.col("_assets")).drop("_neg", "_assets")  # one row
    return each.join(panel_synchrony(z, q).withColumnRenamed("synchrony", "synchrony_95"), "begin")


def panel(rows: DataFrame, least: int) -> DataFrame:
    """Regular bars of assets with enough of them, at times that at least 60 % of the assets, and three, have."""
    from shockwell.operators.quality import large_enough

    kept = large_enough(rows.where("regular_session"), least)
    assets = kept.agg(F.count_distinct("asset").alias("_assets"))
    times = kept.groupBy("begin").agg(F.count("z_return").alias("_k")).crossJoin(F.broadcast(assets)).where(F.col("_k") >= F.greatest(F.lit(3), F.ceil(0.6 * F.col("_assets"))))  # one row
    return kept.join(times.select("begin"), "begin", "left_semi")
