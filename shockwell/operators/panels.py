"""Small tables over other operators' results: overlays, grids, verdicts and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockwell.functions.columns import median


def instrument_label(secid: Column | str, shortname: Column | str, board: Column | str) -> Column:
    """'name — CODE · board'; without a name the code stands for it, without a board nothing follows."""
    blank = lambda x: F.when(F.lower(F.trim(x)).isin("", "nan"), F.lit(None)).otherwise(F.trim(x))
    code = F.upper(F.trim(F.coalesce(F.col(secid) if isinstance(secid, str) else secid, F.lit(""))))
    return F.concat(F.coalesce(blank(shortname), code), F.lit(" — "), code, F.coalesce(F.concat(F.lit(" · "), blank(board)), F.lit("")))


def record_text(parameters: Column | str) -> Column:
    """Named parameters as 'k=v, ...' in the order of the names, with four significant digits."""
    pairs = F.array_sort(F.map_entries(parameters))
    return F.array_join(F.transform(pairs, lambda p: F.format_string("%s=%s", p["key"], four_digits(p["value"]))), ", ")


def four_digits(x: Column) -> Column:
    """A number rounded to four significant digits, without trailing zeros."""
    size = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))))
    shift = F.pow(F.lit(10.0), 3 - size)
    rounded = (F.round(x * shift) / shift).cast("decimal(38,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def mobility_grid(bins: DataFrame, fits: DataFrame, points: int = 200) -> DataFrame:
    """(asset, model, price, mobility): each law over evenly spaced prices between an asset's lowest and highest bin."""
    span = bins.groupBy("asset").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step")
    grid = span.select("asset", step, "low", "high").withColumn("price", F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / (points - 1))
    return grid.join(fits.select("asset", "model", "a", "b"), "asset").select("asset", "model", "step", "price", (F.col("a") + F.col("b") * F.col("price")).alias("mobility"))


def typical_start(paths: DataFrame, initial: int = 3) -> DataFrame:
    """(process_class, direction, x): the median over events of their median early response, at least 0."""
    by = ["process_class", "direction"]
    each = paths.where(F.col("offset").between(1, initial)).groupBy(*by, "event_id").agg(F.greatest(median("abnormal_m2"), F.lit(0.0)).alias("x"))
    return each.groupBy(*by).agg(median("x").alias("x"))


def amplitude_overlay(paths: DataFrame, fits: DataFrame, initial: int = 3, last: int = 24) -> DataFrame:
    """(process_class, direction, model, offset, predicted): each law from the typical start on."""
    from shockwell.operators.decay import predict_amplitude

    by = ["process_class", "direction"]
    times = typical_start(paths, initial).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(last - initial))))
    return predict_amplitude(times, fits, by).select(*by, "model", (F.col("t") + initial).alias("offset"), "predicted")


def decay_overlay(fits: DataFrame, by: list[str]) -> DataFrame:
    """(`by`, model, offset, predicted): each fitted law over its own segment, with time from its beginning."""
    from shockwell.operators.decay import LAWS, _by_law, curve_column

    rows = fits.where("success").withColumn("offset", F.explode(F.sequence("fit_start", "fit_end"))).withColumn("t", (F.col("offset") - F.col("fit_start")).cast("double"))
    told = _by_law(LAWS, lambda m: curve_column(m, F.col("t"), {n: F.col("parameters")[n] for n in LAWS[m][0]}))
    return rows.select(*by, "model", "offset", told.alias("predicted"))


def omori_overlay(fits: DataFrame, horizon: int = 30) -> DataFrame:
    """(asset, offset, probability, excess): the fitted aftershock rate, and what it is above the baseline."""
    from shockwell.operators.decay import omori_probability

    rows = fits.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    p = omori_probability(F.col("offset"), {n: F.col(n) for n in ("baseline_rate", "scale", "shift", "exponent")})
    return rows.select("asset", "offset", p.alias("probability"), (p - F.col("baseline_rate")).alias("excess"))


def error_bars(coefficients: DataFrame) -> DataFrame:
    """Estimates with how far their interval reaches to either side."""
    return coefficients.withColumns({"above": F.col("ci_high") - F.col("estimate"), "below": F.col("estimate") - F.col("ci_low")})


def balance_verdict(balance: DataFrame, bar: float = 0.10) -> DataFrame:
    """The largest standardised difference of each asset's matching, and whether it is small enough."""
    each = balance.groupBy("asset").agg(F.max(F.abs("standardized_mean_difference")).alias("maximum_smd"))
    return each.withColumn("good", F.col("maximum_smd") <= bar)


def validation_verdict(summary: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """(`by`, model, best, spread): the law with the least held-out error, and how far the worst is from it."""
    best = F.min(F.struct(value, "model"))
    each = summary.groupBy(*by).agg(best.alias("b"), (F.max(value) - F.min(value)).alias("spread"))
    return each.select(*by, F.col("b.model").alias("model"), F.col(f"b.{value}").alias("best"), "spread")


def horizon_table(comparisons: dict[str, DataFrame]) -> DataFrame:
    """The horizon comparisons of several methods in one table, in percent."""
    names = ["negative_median_excess", "positive_median_excess", "negative_minus_positive", "difference_ci_low", "difference_ci_high"]
    out = None
    for method, rows in comparisons.items():
        own = rows.withColumns({c: 100 * F.col(c) for c in names}).withColumn("method", F.lit(method))
        out = own if out is None else out.unionByName(own)
    return out
