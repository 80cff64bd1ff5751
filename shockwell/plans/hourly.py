"""Queries over hourly candles: standardisation, moments, mobility, moment shocks and the market panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockwell.functions.columns import median, quantile_bucket, rolling
from shockwell.operators import hourly, quality, trend
from shockwell.operators.responses import bootstrap_interval, weighted_mean, weighted_median
from shockwell.plans.daily import bucket_sql, full
from shockwell.plans.registry import Registry
from shockwell.plans.shocks import draws
from shockwell.sources import candles

#: A month of hours: windows are short, so that every clock hour has enough bars.
WINDOW, LEAST, SAMPLES = 20, 8, 300


def hour_full(fn: str, x: str, low: int, high: int, least: int) -> str:
    over = f"OVER (PARTITION BY asset, hour ORDER BY pos ROWS BETWEEN {-low} PRECEDING AND {-high} PRECEDING)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {fn}({x}) {over} END"


def summary_sql(source: str, x: str, by: str, least: int) -> str:
    """Robustly scaled, winsorised moments of x by group."""
    return f"""SELECT {by}, count(*) AS observations, avg(w) AS mean, sqrt(avg(e * e)) AS standard_deviation, CASE WHEN avg(e * e) > 0 THEN avg(e * e * e) / pow(avg(e * e), 1.5) END * sqrt(count(*) * (count(*) - 1)) / (count(*) - 2) AS skewness, avg(e * e * e) AS m3
      FROM (SELECT *, w - avg(w) OVER (PARTITION BY {by}) AS e FROM (SELECT *, greatest(least(s, quantile_cont(s, 0.995) OVER (PARTITION BY {by})), quantile_cont(s, 0.005) OVER (PARTITION BY {by})) AS w
      FROM (SELECT *, d / CASE WHEN mad > 1e-12 THEN mad / 0.67448975 WHEN sd > 1e-12 THEN sd ELSE 1 END AS s FROM (SELECT *, median(abs(dm)) OVER (PARTITION BY {by}) AS mad FROM (SELECT *, d - median(d) OVER (PARTITION BY {by}) AS dm, stddev_pop(d) OVER (PARTITION BY {by}) AS sd
      FROM (SELECT *, {x} - median({x}) OVER (PARTITION BY {by}) AS d FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS cnt FROM {source} WHERE {x} IS NOT NULL) WHERE cnt >= {least}))))))
      GROUP BY {by}"""


def register(r: Registry) -> None:
    from shockwell.plans.daily import candle_sql

    r.cte("hourly", candle_sql("events", "event_type", "date_trunc('hour', ts)", "value", "1.0", "row(ts, event_id)"))
    r.cte("prepared", "SELECT *, CAST(begin AS DATE) AS date, CAST(year(begin) AS INTEGER) AS year, CAST(hour(begin) AS INTEGER) AS hour, ln(close / open) AS log_return_oc, close - open AS price_increment, open AS price, TRUE AS regular_session FROM hourly")
    r.cte("scaled", f"SELECT *, coalesce({hour_full('median', 'ar', -WINDOW, -1, LEAST)} / 0.67448975, greatest(median(ar) OVER (PARTITION BY asset, hour) / 0.67448975, 1e-8)) AS scale_mad FROM (SELECT *, abs(log_return_oc) AS ar FROM prepared)")
    r.cte("corrected", f"SELECT *, greatest(least(coalesce(sqrt({hour_full('avg', 'sq', -WINDOW, -1, LEAST)}), 1), 3), 0.5) AS rms_correction FROM (SELECT *, CASE WHEN scale_mad <> 0 THEN pow(greatest(least(log_return_oc / scale_mad, 5), -5), 2) END AS sq FROM scaled)")
    r.cte("z", """SELECT *, z_return * z_return AS m2_instant, CASE WHEN z_return IS NOT NULL THEN least(z_return * z_return, 36) END AS m2_clipped, CASE WHEN z_return IS NOT NULL THEN pow(greatest(least(z_return, 6), -6), 3) END AS m3_instant, z_return * abs(z_return) AS signed_m2
      FROM (SELECT *, scale_mad * rms_correction AS conditional_scale, CASE WHEN scale_mad <> 0 THEN greatest(least(log_return_oc / (scale_mad * rms_correction), 8), -8) END AS z_return FROM corrected)""")
    prepared = lambda s, d: quality.prepared_hourly(candles.hourly_candles(s, d), 0, 23)
    z = lambda s, d: r.keep(hourly.standardised(prepared(s, d), WINDOW, LEAST))
    key = "asset pos begin"
    r.add("s8_hourly_candles", key, "open high low close volume value", candles.hourly_candles, "SELECT * FROM hourly")
    r.add("c9_prepared_hourly", key + " date year hour regular_session", "log_return_oc price_increment price", lambda s, d: quality.prepared_hourly(candles.hourly_candles(s, d)), "SELECT * REPLACE (hour BETWEEN 10 AND 18 AS regular_session) FROM prepared")
    r.add("c13_large_assets", "asset bars", "", lambda s, d: quality.large_enough(prepared(s, d), 500).groupBy("asset").agg(F.count("*").alias("bars")), "SELECT asset, count(*) AS bars FROM prepared GROUP BY 1 HAVING count(*) >= 500")
    r.add("h1_standardised", key, "scale_mad rms_correction conditional_scale z_return m2_instant m2_clipped m3_instant signed_m2", z, "SELECT * FROM z", digits=7)
    r.cte("centred", f"SELECT *, z_return - {full('avg', 'z_return', -59, 0, 30)} AS c, CASE WHEN z_return < 0 THEN z_return * z_return ELSE 0 END AS dn, CASE WHEN z_return > 0 THEN z_return * z_return ELSE 0 END AS up FROM z")
    r.add("h2_standardised_moments", key, "m2 m3 skewness signed_m2_mean downside_share", lambda s, d: hourly.standardised_moments(z(s, d), 60),
          f"SELECT *, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END AS skewness, d / nullif(d + u, 0) AS downside_share FROM (SELECT *, {full('avg', 'c2', -59, 0, 30)} AS m2, {full('avg', 'c3', -59, 0, 30)} AS m3, {full('avg', 'signed_m2', -59, 0, 30)} AS signed_m2_mean, {full('avg', 'dn', -59, 0, 30)} AS d, {full('avg', 'up', -59, 0, 30)} AS u FROM (SELECT *, c * c AS c2, c * c * c AS c3 FROM centred))", digits=7)
    moments = "mean standard_deviation skewness m3"
    r.add("h4_session_moments", "asset hour observations", moments, lambda s, d: hourly.session_moments(prepared(s, d), 20), summary_sql("prepared", "log_return_oc", "asset, hour", 20), digits=7)
    r.cte("nights", "SELECT *, ln(first_open / lag(last_close) OVER (PARTITION BY asset ORDER BY date)) AS r FROM (SELECT asset, date, arg_min(open, pos) AS first_open, arg_max(close, pos) AS last_close FROM prepared GROUP BY ALL)")
    r.cte("labelled", "SELECT *, unnest(list_filter(['all', CASE WHEN year(date) <> 2022 THEN 'exclude_year' END, CASE WHEN abs(r) < ln(1.2) THEN 'absolute_gap_below_20pct' END, CASE WHEN year(date) <> 2022 AND abs(r) < ln(1.2) THEN 'exclude_year_and_20pct' END], lambda x: x IS NOT NULL)) AS filter FROM nights")
    r.add("h5_overnight_moments", 'asset filter observations', moments, lambda s, d: hourly.overnight_moments(prepared(s, d)), summary_sql("labelled", "r", 'asset, "filter"', 20), digits=7)
    # Mobility needs several years: daily candles of all assets together.
    daily = lambda s, d: quality.prepared_hourly(candles.daily_candles(s, d), 0, 23)
    bins = lambda s, d: r.keep(hourly.price_bins(daily(s, d), 8, 20, 200))
    r.cte("days", "SELECT *, CAST(year(begin) AS INTEGER) AS year, ln(close / open) AS log_return_oc, close - open AS price_increment, open AS price FROM daily")
    r.cte("trimmed", "SELECT * FROM (SELECT *, quantile_cont(x, 0.005) OVER (PARTITION BY asset, year) AS lo, quantile_cont(x, 0.995) OVER (PARTITION BY asset, year) AS hi FROM (SELECT *, price_increment AS x, count(*) OVER (PARTITION BY asset, year) AS cnt FROM days) WHERE cnt >= 200) WHERE x BETWEEN lo AND hi")
    r.cte("bucketed", bucket_sql("price", 8, "asset, year", "trimmed"))
    r.cte("bins", "SELECT asset, year, CAST(bucket AS INTEGER) AS bucket, avg(price) AS price, count(*) AS observations, sqrt(avg(e * e)) AS mobility, avg(e * e) AS m2_price, avg(e * e * e) AS m3_price, avg(e * e * e) / nullif(pow(avg(e * e), 1.5), 0) AS skew_price FROM (SELECT *, x - avg(x) OVER (PARTITION BY asset, year, bucket) AS e FROM bucketed) GROUP BY ALL HAVING count(*) >= 20")
    r.add("h6_price_bins", "asset year bucket observations", "price mobility skew_price", bins, "SELECT * FROM bins", digits=6)
    affine = "CASE WHEN a >= 0 AND b >= 0 THEN {i} WHEN lb <= la THEN {x} ELSE {y} END"
    solved = lambda rows, by: f"""SELECT {by}, m.model, CASE m.model WHEN 'constant' THEN y / w WHEN 'proportional' THEN 0 ELSE {affine.format(i='a', x='0', y='oa')} END AS a, CASE m.model WHEN 'constant' THEN 0 WHEN 'proportional' THEN ob ELSE {affine.format(i='b', x='ob', y='0')} END AS b
      FROM (SELECT *, ob * ob * xx - 2 * ob * xy AS lb, oa * oa * w - 2 * oa * y AS la FROM (SELECT *, (y * xx - x * xy) / (w * xx - x * x) AS a, (w * xy - x * y) / (w * xx - x * x) AS b, greatest(y / w, 0) AS oa, greatest(xy / xx, 0) AS ob FROM ({rows}))) CROSS JOIN (SELECT unnest(['constant', 'proportional', 'affine']) AS model) m"""  # noqa: E731
    sums = "sum(1.0 * observations) AS w, sum(observations * price) AS x, sum(observations * mobility) AS y, sum(observations * price * price) AS xx, sum(observations * price * mobility) AS xy"
    r.cte("mobility_fits", solved(f"SELECT asset, {sums} FROM bins GROUP BY 1", "asset"))
    r.add("h9_mobility_fits", "asset model sample_size", "a b r_squared rmse", lambda s, d: hourly.fit_mobility(bins(s, d)),
          "SELECT asset, model, a, b, 1 - sum(observations * e * e) / nullif(sum(observations * pow(mobility - m, 2)), 0) AS r_squared, sqrt(avg(e * e)) AS rmse, count(*) AS sample_size FROM (SELECT *, mobility - a - b * price AS e, sum(observations * mobility) OVER (PARTITION BY asset, model) / sum(observations) OVER (PARTITION BY asset, model) AS m FROM bins JOIN mobility_fits USING (asset)) GROUP BY ALL", digits=4)
    keys = ("w", "x", "y", "xx", "xy")
    rest = ", ".join(f"sum({k}) OVER (PARTITION BY asset) - {k} AS {k}" for k in keys)
    r.cte("left_out", f"SELECT * FROM (SELECT asset, year, {rest}, sum(n) OVER (PARTITION BY asset) - n AS train, n FROM (SELECT asset, year, count(*) AS n, {sums} FROM bins GROUP BY ALL)) WHERE train >= 12 AND n >= 3")
    r.cte("year_fits", solved("SELECT * FROM left_out", "asset, year"))
    r.add("h9_mobility_validation", "asset model years winner", "mean median std", lambda s, d: hourly.cross_validate_mobility(bins(s, d)),
          "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(mean, 9), model) = 1 AS winner FROM (SELECT asset, model, avg(error) AS mean, median(error) AS median, stddev_samp(error) AS std, count(*) AS years FROM (SELECT asset, year, model, sqrt(sum(observations * pow(mobility - a - b * price, 2)) / sum(observations)) / (sum(observations * mobility) / sum(observations)) AS error FROM bins JOIN year_fits USING (asset, year) GROUP BY ALL) GROUP BY ALL)", digits=6)
    r.cte("steps", " UNION ALL ".join(f"SELECT asset, {h} AS horizon_hours, begin, open, price, lead(close, {h - 1}) OVER w AS end_close, lead(begin, {h - 1}) OVER w AS end_begin FROM prepared WINDOW w AS (PARTITION BY asset ORDER BY begin)" for h in (1, 2, 4, 6, 8)))
    r.cte("hourly_law", "SELECT asset, 0.4 AS a, 0.03 AS b FROM prepared GROUP BY 1")
    law = lambda s, d: prepared(s, d).select("asset").distinct().select("asset", F.lit("affine").alias("model"), F.lit(0.4).alias("a"), F.lit(0.03).alias("b"))
    r.cte("residuals", """SELECT *, quantile_cont(r, 0.005) OVER g AS lo, quantile_cont(r, 0.995) OVER g AS hi, count(*) OVER g AS observations FROM (SELECT *, (end_close - open) / ((a + b * price) / b * sqrt(exp(b * b * horizon_hours) - 1)) AS r
      FROM steps JOIN hourly_law USING (asset) WHERE epoch_us(end_begin) - epoch_us(begin) = (horizon_hours - 1) * 3600000000 AND CAST(end_begin AS DATE) = CAST(begin AS DATE)) WHERE isfinite(r) WINDOW g AS (PARTITION BY asset, horizon_hours)""")
    r.add("h11_affine_horizons", "asset horizon_hours observations", "predicted_affine_skewness observed_skewness", lambda s, d: hourly.affine_horizon_test(prepared(s, d), law(s, d)),
          """SELECT asset, CAST(horizon_hours AS INTEGER) AS horizon_hours, observations, (exp(0.0009 * horizon_hours) + 2) * sqrt(exp(0.0009 * horizon_hours) - 1) AS predicted_affine_skewness, avg(e * e * e) / pow(avg(e * e), 1.5) * sqrt(observations * (observations - 1)) / (observations - 2) AS observed_skewness
      FROM (SELECT *, w - avg(w) OVER (PARTITION BY asset, horizon_hours) AS e FROM (SELECT *, least(greatest(r, lo), hi) AS w FROM residuals WHERE observations >= 50)) GROUP BY asset, horizon_hours, observations""", digits=6)
    # The same law fitted to the hourly candles themselves, with the operators' own gates.
    hour_bins = lambda s, d: r.keep(hourly.price_bins(prepared(s, d)))
    r.cte("hours_adjusted", "SELECT *, price_increment / CASE WHEN am > 0 THEN greatest(hm / am, 0.2) ELSE 1 END AS x FROM (SELECT *, median(abs(log_return_oc)) OVER (PARTITION BY asset) AS am, median(abs(log_return_oc)) OVER (PARTITION BY asset, hour) AS hm, count(*) OVER (PARTITION BY asset, year) AS cnt FROM prepared) WHERE cnt >= 400")
    r.cte("hours_trimmed", "SELECT * FROM (SELECT *, quantile_cont(x, 0.005) OVER (PARTITION BY asset, year) AS lo, quantile_cont(x, 0.995) OVER (PARTITION BY asset, year) AS hi FROM hours_adjusted) WHERE x BETWEEN lo AND hi")
    r.cte("hours_bucketed", bucket_sql("price", 8, "asset, year", "hours_trimmed"))
    r.cte("hours_bins", "SELECT asset, year, CAST(bucket AS INTEGER) AS bucket, avg(price) AS price, count(*) AS observations, sqrt(avg(e * e)) AS mobility, avg(e * e * e) / nullif(pow(avg(e * e), 1.5), 0) AS skew_price FROM (SELECT *, x - avg(x) OVER (PARTITION BY asset, year, bucket) AS e FROM hours_bucketed) GROUP BY ALL HAVING count(*) >= 40")
    r.cte("hours_fits", solved(f"SELECT asset, {sums} FROM hours_bins GROUP BY 1", "asset"))
    r.add("h6_hourly_price_bins", "asset year bucket observations", "price mobility skew_price", hour_bins, "SELECT * FROM hours_bins", digits=6)
    r.add("h9_hourly_mobility_fits", "asset model", "a b", lambda s, d: hourly.fit_mobility(hour_bins(s, d)), "SELECT * FROM hours_fits", digits=5)
    affine_fits = lambda s, d: r.queries["h9_hourly_mobility_fits"](s, d).where("model = 'affine'")
    r.add("h10_affine_skewness", "asset h", "skewness", lambda s, d: affine_fits(s, d).select("asset", "b", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("h")).select("asset", "h", hourly.affine_skewness(F.col("b"), F.col("h")).alias("skewness")),
          f"SELECT asset, h, CASE WHEN b > 1e-12 THEN (exp(b * b * h) + 2) * sqrt(exp(b * b * h) - 1) ELSE 0 END AS skewness FROM ({r.sql['h9_hourly_mobility_fits']}) CROSS JOIN (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS h) WHERE model = 'affine'", digits=6)
    r.cte("fitted_residuals", """SELECT *, quantile_cont(r, 0.005) OVER g AS lo, quantile_cont(r, 0.995) OVER g AS hi, count(*) OVER g AS observations FROM (SELECT *, (end_close - open) / CASE WHEN b > 1e-12 THEN (a + b * price) / b * sqrt(exp(b * b * horizon_hours) - 1) ELSE a * sqrt(horizon_hours) END AS r
      FROM steps JOIN hours_fits USING (asset) WHERE model = 'affine' AND epoch_us(end_begin) - epoch_us(begin) = (horizon_hours - 1) * 3600000000 AND CAST(end_begin AS DATE) = CAST(begin AS DATE)) WHERE isfinite(r) WINDOW g AS (PARTITION BY asset, horizon_hours)""")
    r.add("h11_fitted_horizons", "asset horizon_hours observations", "predicted_affine_skewness observed_skewness", lambda s, d: hourly.affine_horizon_test(prepared(s, d), hourly.fit_mobility(hour_bins(s, d))),
          """SELECT asset, CAST(horizon_hours AS INTEGER) AS horizon_hours, observations, CASE WHEN b > 1e-12 THEN (exp(b * b * horizon_hours) + 2) * sqrt(exp(b * b * horizon_hours) - 1) ELSE 0 END AS predicted_affine_skewness, avg(e * e * e) / pow(avg(e * e), 1.5) * sqrt(observations * (observations - 1)) / (observations - 2) AS observed_skewness
      FROM (SELECT *, w - avg(w) OVER (PARTITION BY asset, horizon_hours) AS e FROM (SELECT *, least(greatest(r, lo), hi) AS w FROM fitted_residuals WHERE observations >= 50)) GROUP BY asset, horizon_hours, observations, b""", digits=4)
    # Moment shocks
    r.cte("synchrony", "SELECT begin, count(*) FILTER (abs(z_return) > bar) / (SELECT count(DISTINCT asset) FROM z) AS synchrony FROM z JOIN (SELECT asset, quantile_cont(abs(z_return), 0.95) AS bar FROM z GROUP BY 1) USING (asset) GROUP BY 1")
    r.add("h15_panel_synchrony", "begin", "synchrony", lambda s, d: hourly.panel_synchrony(z(s, d)), "SELECT * FROM synchrony")
    r.cte("market", "SELECT begin, median(c * c) AS market_m2, avg(c * c * c) AS market_m3, count(*) FILTER (c < 0) / (SELECT count(DISTINCT asset) FROM z) AS negative_share, count(c) AS assets FROM (SELECT *, CASE WHEN z_return IS NOT NULL THEN greatest(least(z_return, 6), -6) END AS c FROM z) GROUP BY 1")
    r.cte("synchrony_clipped", "SELECT begin, count(*) FILTER (abs(c) > bar) / (SELECT count(DISTINCT asset) FROM z) AS synchrony_95 FROM (SELECT *, CASE WHEN z_return IS NOT NULL THEN greatest(least(z_return, 6), -6) END AS c FROM z) JOIN (SELECT asset, quantile_cont(abs(CASE WHEN z_return IS NOT NULL THEN greatest(least(z_return, 6), -6) END), 0.95) AS bar FROM z GROUP BY 1) USING (asset) GROUP BY 1")
    r.add("h16_market_moments", "begin assets", "market_m2 market_m3 negative_share synchrony_95", lambda s, d: hourly.market_moments(z(s, d)), "SELECT * FROM market JOIN synchrony_clipped USING (begin)", digits=7)
    r.add("h17_panel", "asset begin", "z_return", lambda s, d: hourly.panel(z(s, d), 500), "SELECT asset, begin, z_return FROM (SELECT *, count(z_return) OVER (PARTITION BY begin) AS k FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM z) WHERE n >= 500) WHERE k >= greatest(3, ceil(0.6 * (SELECT count(*) FROM (SELECT asset FROM z GROUP BY 1 HAVING count(*) >= 500))))", digits=7)
    over = "OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN"
    for tag, q in (("", 0.97), ("_rare", 0.99)):
        r.cte(f"candidates{tag}", f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY pos) - 1 AS event_id FROM (SELECT *, avg(m2_clipped) {over} 12 PRECEDING AND 1 PRECEDING) AS precursor_m2, avg(m2_clipped) {over} 48 PRECEDING AND 25 PRECEDING) AS far_m2, quantile_cont(abs(z_return), {q}) OVER (PARTITION BY asset) AS threshold, count(*) OVER (PARTITION BY asset) AS n FROM z) WHERE abs(z_return) >= threshold")
        r.cte(f"taken{tag}", f"SELECT asset, unnest(list_reduce(list_transform(ps, lambda c: [c]), lambda acc, x: CASE WHEN x[1] - acc[-1] < 12 THEN acc ELSE list_concat(acc, x) END)) AS pos FROM (SELECT asset, list(pos ORDER BY pos) AS ps FROM candidates{tag} WHERE pos >= 48 AND pos + 24 < n GROUP BY 1)")
        r.cte(f"moment_shocks{tag}", f"""SELECT *, CASE WHEN heating_class = 'abrupt-like' AND synchrony_class = 'market-wide' THEN 'external-like' WHEN heating_class = 'preheated-like' AND synchrony_class = 'isolated' THEN 'internal-like' ELSE 'other' END AS process_class FROM
          (SELECT *, CASE WHEN precursor_rank <= 0.4 THEN 'abrupt-like' WHEN precursor_rank >= 0.6 THEN 'preheated-like' ELSE 'intermediate' END AS heating_class, CASE WHEN synchrony >= 0.4 THEN 'market-wide' WHEN synchrony <= 0.2 THEN 'isolated' ELSE 'intermediate' END AS synchrony_class FROM
          (SELECT c.*, s.synchrony, CASE WHEN z_return < 0 THEN 'negative' ELSE 'positive' END AS direction, (rank() OVER (PARTITION BY c.asset ORDER BY precursor_m2) + (count(*) OVER (PARTITION BY c.asset, precursor_m2) - 1) / 2.0) / count(*) OVER (PARTITION BY c.asset) AS precursor_rank FROM candidates{tag} c JOIN taken{tag} t ON c.asset = t.asset AND c.pos = t.pos LEFT JOIN synchrony s ON s.begin = c.begin))""")

    def shocks(s, d):
        rows = z(s, d)
        return r.keep(hourly.moment_shocks(rows, 0.97, synchrony=hourly.panel_synchrony(rows)))

    r.add("h12_moment_shocks", "asset event_id pos begin direction heating_class synchrony_class process_class", "z_return precursor_m2 far_m2 synchrony threshold precursor_rank", shocks, "SELECT * FROM moment_shocks", digits=7)
    rare = lambda s, d: hourly.moment_shocks(rows := z(s, d), synchrony=hourly.panel_synchrony(rows))
    r.add("h12_rare_moment_shocks", "asset event_id pos begin direction heating_class synchrony_class process_class", "z_return precursor_m2 far_m2 synchrony threshold precursor_rank", rare, "SELECT * FROM moment_shocks_rare", digits=7)
    paths = lambda s, d: r.keep(hourly.matched_moments(z(s, d), shocks(s, d))[0])
    r.cte("hour_bars", f"""SELECT *, ln(1 + greatest(p12, 0)) AS f1, ln(1 + greatest(far, 0)) AS f2, s12 / sqrt(greatest(far, 0.1)) AS f3, quantile_cont(abs(z_return), 0.95) OVER (PARTITION BY asset) AS cap FROM (SELECT *, {full('avg', 'm2_clipped', -12, -1, 8)} AS p12, {full('avg', 'm2_clipped', -48, -25, 16)} AS far, {full('sum', 'log_return_oc', -12, -1, 8)} AS s12,
      {full('avg', 'm2_clipped', -12, -1, 1)} AS base, count(m2_clipped) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS filled, count(*) OVER (PARTITION BY asset) AS n FROM z)""")
    r.cte("hour_pool", "SELECT * FROM hour_bars b WHERE abs(z_return) < cap AND pos >= 48 AND pos < n - 24 AND f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM moment_shocks e WHERE e.asset = b.asset AND b.pos BETWEEN e.pos - 24 AND e.pos + 24)")
    r.cte("hour_mids", "SELECT asset, median(f1) AS k1, median(f2) AS k2, median(f3) AS k3 FROM hour_pool GROUP BY 1")
    r.cte("hour_mads", "SELECT p.asset, median(abs(f1 - k1)) AS d1, median(abs(f2 - k2)) AS d2, median(abs(f3 - k3)) AS d3 FROM hour_pool p JOIN hour_mids USING (asset) GROUP BY 1")
    r.cte("hour_matches", """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY asset, event_id) AS k FROM (SELECT e.asset, e.event_id, e.pos AS event_position, e.direction, e.process_class, p.pos AS control_position, p.base, p.filled,
      pow((b.f1 - p.f1) / CASE WHEN d1 <> 0 THEN d1 ELSE 1 END, 2) + pow((b.f2 - p.f2) / CASE WHEN d2 <> 0 THEN d2 ELSE 1 END, 2) + pow((b.f3 - p.f3) / CASE WHEN d3 <> 0 THEN d3 ELSE 1 END, 2) + 0.03 * abs(epoch_us(p.begin) - epoch_us(b.begin)) / 86400000000.0 / 365 AS distance
      FROM moment_shocks e JOIN hour_bars b ON b.asset = e.asset AND b.pos = e.pos AND b.f1 IS NOT NULL AND b.f2 IS NOT NULL AND b.f3 IS NOT NULL JOIN hour_pool p ON p.asset = b.asset AND p.hour = b.hour JOIN hour_mads m ON m.asset = e.asset
      QUALIFY row_number() OVER (PARTITION BY e.asset, e.event_id ORDER BY distance, p.pos) <= 8)) WHERE k >= 4""")
    r.cte("hour_events", "SELECT asset, event_id, event_position, direction, process_class, count(*) AS controls, avg(distance) AS mean_distance, greatest(sum(base * filled) / sum(filled), 0.2) AS baseline FROM hour_matches GROUP BY ALL")
    r.cte("hour_paths", """SELECT e.asset, e.event_id, e.direction, e.process_class, o.k AS "offset", (v.m2_clipped - c.c2) / e.baseline AS abnormal_m2, (v.m3_instant - c.c3) / pow(e.baseline, 1.5) AS abnormal_m3 FROM hour_events e CROSS JOIN (SELECT CAST(unnest(range(-12, 25)) AS INTEGER) AS k) o JOIN z v ON v.asset = e.asset AND v.pos = e.event_position + o.k
      JOIN (SELECT m.asset, m.event_id, o.k, median(v.m2_clipped) AS c2, avg(v.m3_instant) AS c3 FROM hour_matches m CROSS JOIN (SELECT CAST(unnest(range(-12, 25)) AS INTEGER) AS k) o JOIN z v ON v.asset = m.asset AND v.pos = m.control_position + o.k GROUP BY ALL) c ON c.asset = e.asset AND c.event_id = e.event_id AND c.k = o.k""")
    r.add("h13_matched_paths", "asset event_id direction process_class offset", "abnormal_m2 abnormal_m3", paths, "SELECT * FROM hour_paths", digits=6)
    r.add("h13_matches", "asset event_id controls", "mean_distance baseline", lambda s, d: hourly.matched_moments(z(s, d), shocks(s, d))[1], "SELECT * FROM hour_events", digits=6)

    def aggregate(s, d):
        rows = paths(s, d)
        by = ["process_class", "direction"]
        rows = rows.withColumn("event_id", F.concat_ws("-", "asset", F.format_string("%06d", F.col("event_id").cast("int"))))
        stats = rows.groupBy(*by, "offset").agg(F.count("*").alias("events"), median("abnormal_m2").alias("median_abnormal_m2"), F.avg("abnormal_m3").alias("mean_abnormal_m3"))
        for value, name, fn in (("abnormal_m2", "m2", weighted_median), ("abnormal_m3", "m3", weighted_mean)):
            ci = bootstrap_interval(rows, value, by, ["offset"], fn, SAMPLES, 2026).withColumnsRenamed({"bootstrap_ci_low": f"{name}_ci_low", "bootstrap_ci_high": f"{name}_ci_high"})
            stats = stats.join(ci, [*by, "offset"])
        return stats

    r.cte("named_paths", "SELECT * REPLACE (asset || '-' || printf('%06d', event_id) AS event_id) FROM hour_paths")
    r.add("h14_moment_summary", "process_class direction offset events", "median_abnormal_m2 m2_ci_low m2_ci_high mean_abnormal_m3 m3_ci_low m3_ci_high", aggregate,
          f"""SELECT * FROM (SELECT process_class, direction, "offset", count(*) AS events, median(abnormal_m2) AS median_abnormal_m2, avg(abnormal_m3) AS mean_abnormal_m3 FROM named_paths GROUP BY ALL)
          JOIN (SELECT process_class, direction, "offset", quantile_cont(s2, 0.025) AS m2_ci_low, quantile_cont(s2, 0.975) AS m2_ci_high, quantile_cont(s3, 0.025) AS m3_ci_low, quantile_cont(s3, 0.975) AS m3_ci_high FROM
            (SELECT d.process_class, d.direction, sample, "offset", median(abnormal_m2) AS s2, avg(abnormal_m3) AS s3 FROM ({draws('named_paths', 2026, 'process_class, direction', SAMPLES)}) d JOIN named_paths x ON x.process_class = d.process_class AND x.direction = d.direction AND x.event_id = d.event_id GROUP BY ALL) GROUP BY ALL) USING (process_class, direction, "offset")""", digits=6)

    def diagnostic(s, d):
        m = hourly.market_moments(z(s, d)).withColumn("asset", F.lit("market")).withColumn("pos", F.row_number().over(_time()) - 1)
        m = m.withColumn("past_m3", rolling(F.avg, "market_m3", -5, 0, 3)).withColumn("future_m2", rolling(F.avg, "market_m2", 1, 6, 1)).dropna(subset=["past_m3", "future_m2"])
        return m

    def _time():
        from pyspark.sql.window import Window

        return Window.partitionBy("asset").orderBy("begin")

    r.cte("ahead_market", f"SELECT * FROM (SELECT *, {full('avg', 'market_m3', -5, 0, 3)} AS past_m3, {full('avg', 'market_m2', 1, 6, 1)} AS future_m2 FROM (SELECT *, 'market' AS asset, row_number() OVER (ORDER BY begin) - 1 AS pos FROM market)) WHERE past_m3 IS NOT NULL AND future_m2 IS NOT NULL")
    r.add("h19_future_market_m2", "asset observations", "pearson spearman", lambda s, d: trend.correlations(diagnostic(s, d), "past_m3", "future_m2"),
          f"""SELECT asset, count(*) AS observations, corr(past_m3, future_m2) AS pearson, corr(ra, rb) AS spearman FROM (SELECT *, rank() OVER (ORDER BY past_m3) + (count(*) OVER (PARTITION BY past_m3) - 1) / 2.0 AS ra, rank() OVER (ORDER BY future_m2) + (count(*) OVER (PARTITION BY future_m2) - 1) / 2.0 AS rb FROM (SELECT *, {full('avg', 'market_m3', -5, 0, 3)} AS past_m3, {full('avg', 'market_m2', 1, 6, 1)} AS future_m2 FROM (SELECT *, 'market' AS asset, row_number() OVER (ORDER BY begin) - 1 AS pos FROM market)) WHERE past_m3 IS NOT NULL AND future_m2 IS NOT NULL) GROUP BY 1""", digits=7)
    r.add("h19_market_deciles", "bucket observations", "mean_past mean_future", lambda s, d: diagnostic(s, d).withColumn("bucket", quantile_bucket("past_m3", 10, "asset")).groupBy("bucket").agg(F.count("*").alias("observations"), F.avg("past_m3").alias("mean_past"), F.avg("future_m2").alias("mean_future")),
          f"SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS observations, avg(past_m3) AS mean_past, avg(future_m2) AS mean_future FROM ({bucket_sql('past_m3', 10, 'asset', 'ahead_market')}) GROUP BY ALL", digits=6)
