"""Queries over small tables made of other queries' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockwell.operators import decay, hourly, panels, quality, trend, volatility
from shockwell.plans.daily import full
from shockwell.plans.registry import Registry
from shockwell.sources import candles


def register(r: Registry) -> None:
    own = r.queries
    kind = ["process_class", "direction"]
    listed = lambda s, d: s.read.parquet(f"{d}/supplier.parquet")
    board = lambda: F.when(F.col("s_nationkey") % 3 != 0, F.concat(F.lit("B"), F.col("s_nationkey").cast("string")))
    r.add("s11_instrument_labels", "code label", "", lambda s, d: listed(s, d).select(F.col("s_suppkey").alias("code"), panels.instrument_label(F.concat(F.lit(" s"), F.col("s_suppkey").cast("string")), F.when(F.col("s_acctbal") > 0, F.col("s_name")), board()).alias("label")),
          "SELECT s_suppkey AS code, CASE WHEN s_acctbal > 0 THEN trim(s_name) ELSE 'S' || s_suppkey END || ' — S' || s_suppkey || CASE WHEN s_nationkey % 3 <> 0 THEN ' · B' || s_nationkey ELSE '' END AS label FROM supplier")
    daily = lambda s, d: volatility.variance_proxies(candles.daily_candles(s, d))
    r.cte("squared", "SELECT *, close_return * close_return AS r2 FROM daily_logs")
    r.cte("square_states", f"SELECT *, {full('sum', 'close_return', -19, 0)} AS total, {full('sum', 'r2', -19, 0)} AS energy, {full('avg', 'rp', -4, 0)} AS m5, {full('avg', 'rp', -21, 0)} AS m22, {full('avg', 'r2', 1, 5)} AS ahead5, {full('avg', 'r2', -19, 0)} AS now20 FROM (SELECT *, CASE WHEN r2 > 0 THEN r2 END AS rp FROM squared)")
    columns = "normalized_trend log_daily log_weekly log_monthly future_variance future_volatility current_volatility"
    r.add("t6_trend_volatility_frame", "asset pos begin", columns, lambda s, d: trend.trend_volatility_frame(daily(s, d), "close_return", 20, 5),
          "SELECT * FROM (SELECT asset, pos, begin, CASE WHEN energy > 0 THEN total / sqrt(energy) END AS normalized_trend, ln(rp + 1e-12) AS log_daily, ln(m5 + 1e-12) AS log_weekly, ln(m22 + 1e-12) AS log_monthly, ahead5 AS future_variance, sqrt(252 * ahead5) AS future_volatility, sqrt(252 * now20) AS current_volatility FROM square_states) WHERE normalized_trend IS NOT NULL AND log_daily IS NOT NULL AND log_weekly IS NOT NULL AND log_monthly IS NOT NULL AND future_variance IS NOT NULL AND current_volatility IS NOT NULL", digits=7)
    r.add("c10_display_returns", "asset pos begin", "log_return", lambda s, d: quality.log_returns(candles.sparse_daily_candles(s, d), max_gap_days=2).where("log_return is not null"), "SELECT *, close_return AS log_return FROM sparse_logs WHERE close_return IS NOT NULL")
    bins = lambda s, d: hourly.price_bins(quality.prepared_hourly(candles.daily_candles(s, d), 0, 23), 8, 20, 200)
    grid = """SELECT asset, model, CAST(k AS INTEGER) AS step, low + (high - low) * k / 199 AS price, a + b * (low + (high - low) * k / 199) AS mobility FROM (SELECT asset, min(price) AS low, max(price) AS high FROM bins GROUP BY 1) JOIN mobility_fits USING (asset) CROSS JOIN (SELECT unnest(range(200)) AS k)"""
    r.add("p2_mobility_grid", "asset model step", "price mobility", lambda s, d: panels.mobility_grid(b := bins(s, d), hourly.fit_mobility(b)), grid, digits=3)
    r.add("p5_error_bars", "asset period term", "estimate above below", lambda s, d: panels.error_bars(own["t13_regression_by_period"](s, d)),
          "SELECT asset, period, term, estimate, round(ci_high, 6) - round(estimate, 6) AS above, round(estimate, 6) - round(ci_low, 6) AS below FROM period_regression", digits=6)
    fits = lambda s, d: decay.fit_relaxation(m := own["r11_median_summary"](s, d), decay.fit_gate(m))
    r.add("p6_decay_overlay", "asset direction model offset", "predicted", lambda s, d: panels.decay_overlay(fits(s, d), ["asset", "direction"]), None, digits=4)
    r.add("p7_omori_overlay", "asset offset", "probability excess", lambda s, d: panels.omori_overlay(decay.fit_omori(own["r17_aftershock_excess"](s, d))), None, digits=4)
    named = lambda s, d: own["h13_matched_paths"](s, d).withColumn("event_id", F.concat_ws("-", "asset", "event_id"))
    r.add("p1_amplitude_overlay", "process_class direction model offset", "predicted", lambda s, d: panels.amplitude_overlay(m := named(s, d), decay.amplitude_fits(decay.amplitude_sample(m))), None, digits=4)
    r.cte("balance", "SELECT asset, max(abs(CASE WHEN pooled > 0 THEN (em - cm) / pooled ELSE 0 END)) AS maximum_smd FROM (" + " UNION ALL ".join(f"SELECT asset, avg(event_{f}) AS em, avg(control_{f}) AS cm, sqrt((var_samp(event_{f}) + var_samp(control_{f})) / 2) AS pooled FROM matches GROUP BY 1" for f in ("forecast_log_variance", "log_daily", "log_weekly", "log_monthly", "pretrend")) + ") GROUP BY 1")
    r.add("p10_balance_verdict", "asset good", "maximum_smd", lambda s, d: panels.balance_verdict(own["r6_matching_balance"](s, d)), "SELECT *, maximum_smd <= 0.1 AS good FROM balance", digits=6)
    r.add("p10_mobility_verdict", "asset model", "best spread", lambda s, d: panels.validation_verdict(own["h9_mobility_validation"](s, d), ["asset"]), f"SELECT asset, arg_min(model, (mean, model)) AS model, min(mean) AS best, max(mean) - min(mean) AS spread FROM ({r.sql['h9_mobility_validation']}) GROUP BY 1", digits=5)
    r.add("p10_amplitude_verdict", "process_class direction model", "best spread", lambda s, d: panels.validation_verdict(own["d21_amplitude_validation"](s, d), kind), None, digits=3)
    r.add("p10_walk_forward_verdict", "asset years", "mean_delta_qlike mean_delta_log_mse", lambda s, d: own["t16_walk_forward"](s, d).groupBy("asset").agg(F.count("*").alias("years"), F.avg("delta_qlike_full_minus_baseline").alias("mean_delta_qlike"), F.avg("delta_log_mse_full_minus_baseline").alias("mean_delta_log_mse")), None, digits=5)
    r.add("p10_affine_residual", "asset", "mean_residual", lambda s, d: own["h11_affine_horizons"](s, d).groupBy("asset").agg(F.avg(F.col("observed_skewness") - F.col("predicted_affine_skewness")).alias("mean_residual")), f"SELECT asset, avg(observed_skewness - predicted_affine_skewness) AS mean_residual FROM ({r.sql['h11_affine_horizons']}) GROUP BY 1", digits=5)
    names = "negative_median_excess positive_median_excess negative_minus_positive difference_ci_low difference_ci_high"
    methods = {"HAR conditional median": "r13_horizon_comparisons", "Matched controls": "r13_matched_comparisons"}
    r.add("p11_horizon_table", "asset method horizon negative_events positive_events", names + " bootstrap_p_value", lambda s, d: panels.horizon_table({m: own[n](s, d) for m, n in methods.items()}),
          " UNION ALL BY NAME ".join(f"SELECT * REPLACE ({', '.join(f'100 * {c} AS {c}' for c in names.split())}), '{m}' AS method FROM ({r.sql[n]})" for m, n in methods.items()), digits=5)  # all that the comparisons have, so that nothing is rounded twice
    told = "a b r_squared rmse".split()
    four = lambda c: f"""coalesce(CASE WHEN {c} = 0 THEN '0' ELSE regexp_replace(regexp_replace(CAST(CAST(round({c} * pow(10.0, 3 - floor(log10(abs({c}))))) / pow(10.0, 3 - floor(log10(abs({c})))) AS DECIMAL(38,12)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END, 'null')"""
    r.add("p14_record_text", "asset model text", "", lambda s, d: own["h9_mobility_fits"](s, d).select("asset", "model", panels.record_text(F.create_map(*[x for c in reversed(told) for x in (F.lit(c), F.col(c))])).alias("text")),
          f"SELECT asset, model, {' || '.join(f"""'{', ' if k else ''}{c}=' || {four(c)}""" for k, c in enumerate(told))} AS text FROM ({r.sql['h9_mobility_fits']})")
