"""Queries over shocks of daily candles: innovations, events, responses and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockwell.operators import events, har, responses, volatility
from shockwell.plans.daily import full
from shockwell.plans.registry import Registry
from shockwell.plans.regression_sql import register_regression
from shockwell.sources import candles

#: Coefficients for queries that SQL checks; the fitted ones are tested against least squares in numpy.
FIXED = {"har_const": -0.5, "har_daily": 0.2, "har_weekly": 0.3, "har_monthly": 0.4, "har_smearing": 1.3}
FORECAST = "greatest(least(-0.5 + 0.2 * ln({h}[-1] + 1e-12) + 0.3 * ln(list_avg({h}[-5:]) + 1e-12) + 0.4 * ln(list_avg({h}[-22:]) + 1e-12), 20), -40)"
#: The operators' own numbers of bootstrap draws.
SAMPLES, HORIZON_SAMPLES = 500, 2000


def greedy(group: str) -> str:
    return f"list_reduce(list_transform({group}, lambda c: [c]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda p: abs(p - x[1]) <= 10)) > 0 THEN acc ELSE list_concat(acc, x) END)"


def event_sql(source: str, score: str, fn: str = "quantile_cont") -> str:
    """Greedy suppression: candidates by falling score, cooldown 10, quantile 0.95."""
    return f"""SELECT *, row_number() OVER (PARTITION BY asset ORDER BY pos) - 1 AS event_id FROM
      (SELECT s.*, b.threshold FROM {source} s JOIN (SELECT asset, {fn}({score}, 0.95) AS threshold FROM {source} GROUP BY 1) b USING (asset)) e
      SEMI JOIN (SELECT asset, unnest({greedy('ps')}) AS pos FROM (SELECT c.asset, list(c.pos ORDER BY c.{score} DESC, c.pos) AS ps FROM {source} c
        JOIN (SELECT asset, {fn}({score}, 0.95) AS threshold FROM {source} GROUP BY 1) b ON c.asset = b.asset AND c.{score} >= b.threshold GROUP BY 1)) k ON e.asset = k.asset AND e.pos = k.pos"""


def draws(rows: str, seed: int, by: str, samples: int = SAMPLES) -> str:
    """Each sample's events, drawn by hashes as `responses.resampled` does."""
    join = " AND ".join(f"t.{c} = i.{c}" for c in by.split(", "))
    columns = ", ".join(f"t.{c}" for c in by.split(", "))
    return f"""SELECT {columns}, sample, i.event_id FROM (SELECT {by}, size, sample, unnest(range(size)) AS turn FROM (SELECT {by}, count(DISTINCT event_id) AS size, unnest(range(1, {samples + 1})) AS sample FROM {rows} GROUP BY {by})) t
      JOIN (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY event_id) - 1 AS idx FROM (SELECT DISTINCT {by}, event_id FROM {rows})) i ON {join} AND i.idx = CAST('0x' || substr(md5('{seed}|' || sample || '|' || turn), 1, 8) AS BIGINT) % t.size"""


def register(r: Registry) -> None:
    # Kept while a query runs: events, controls and paths all read them, and Spark knows an equal plan again.
    q = "gap_rogers_satchell"
    prox = lambda s, d: r.keep(volatility.variance_proxies(candles.daily_candles(s, d)))
    diag = lambda s, d: r.keep(har.innovations(prox(s, d), q, coefficients=FIXED))
    shocks = lambda s, d: r.keep(events.volatility_shocks(diag(s, d)))

    def with_events(f):
        def run(s, d):
            rows = diag(s, d)
            return f(rows, r.keep(events.volatility_shocks(rows)))

        return run

    r.cte("lagged", f"""SELECT *, CASE WHEN q > 0 THEN ln(q + 1e-12) END AS target, ln({full('avg', 'qp', -1, -1)} + 1e-12) AS h_daily, ln({full('avg', 'qp', -5, -1)} + 1e-12) AS h_weekly, ln({full('avg', 'qp', -22, -1)} + 1e-12) AS h_monthly,
      {full('sum', 'close_return', -20, -1)} AS past_total, {full('sum', 'q', -20, -1)} AS past_energy
      FROM (SELECT *, gap_rogers_satchell AS q, CASE WHEN gap_rogers_satchell > 0 THEN gap_rogers_satchell END AS qp FROM prox)""")
    r.cte("recents", "SELECT *, CASE WHEN qp IS NOT NULL THEN list(qp) OVER (PARTITION BY asset, qp IS NOT NULL ORDER BY pos ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) END AS recent FROM lagged")
    r.cte("histories", "SELECT *, CASE WHEN len(h) = 22 THEN h END AS history FROM (SELECT *, last_value(recent IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM recents)")
    r.cte("forecasts", f"""SELECT *, ln(forecast_variance + 1e-12) AS forecast_log_variance, target - ln(forecast_variance + 1e-12) AS innovation FROM (SELECT *, CASE WHEN pos >= 252 AND q > 0 AND history IS NOT NULL THEN exp({FORECAST.format(h='history')}) * 1.3 END AS forecast_variance FROM histories)""")
    r.cte("mids", "SELECT *, list_median(past) AS mid FROM (SELECT asset, pos, innovation, list(innovation) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS past FROM forecasts WHERE innovation IS NOT NULL) WHERE len(past) >= 30")
    r.cte("scores", "SELECT asset, pos, s AS innovation_scale, (innovation - mid) / s AS shock_score FROM (SELECT *, 1.4826 * list_median(list_transform(past, lambda x: abs(x - mid))) AS s FROM mids) WHERE s > 1e-8")
    r.cte("diag", "SELECT f.*, s.innovation_scale, s.shock_score FROM forecasts f LEFT JOIN scores s ON f.asset = s.asset AND f.pos = s.pos")
    r.cte("shocks", f"""SELECT *, CASE WHEN close_return < 0 THEN 'negative' WHEN close_return > 0 THEN 'positive' ELSE 'zero' END AS direction, CASE WHEN gap_share >= 0.67 THEN 'overnight-dominated' WHEN gap_share <= 0.33 THEN 'intraday-dominated' ELSE 'mixed' END AS source
      FROM (SELECT *, CASE WHEN overnight_gap_squared + intraday_rs > 0 THEN overnight_gap_squared / (overnight_gap_squared + intraday_rs) END AS gap_share FROM ({event_sql('diag', 'shock_score')}))""")
    r.cte("lengths", "SELECT asset, max(pos) + 1 AS n FROM diag GROUP BY 1")
    r.cte("ahead", f"SELECT asset, pos, {full('avg', 'qp', 0, 4)} AS v FROM diag")
    r.cte("paths", f"""SELECT e.asset, e.event_id, e.pos, e.direction, e.shock_score, list_reduce(list_concat([e.history], list_transform(range(36), lambda i: [0.0])), lambda acc, x: list_append(acc, exp({FORECAST.format(h='acc')}))) AS path
      FROM shocks e JOIN lengths l USING (asset) WHERE e.pos >= 22 AND e.pos + 35 < n AND e.history IS NOT NULL""")
    smear = f"exp({FORECAST.format(h='acc')}) * 1.3"
    r.cte("raw_histories", f"SELECT asset, pos, CASE WHEN list_min(h) > 0 THEN h END AS raw_history FROM (SELECT asset, pos, {full('list', 'q', -22, -1)} AS h FROM diag)")
    r.cte("raw_ahead", f"SELECT asset, pos, {full('avg', 'q', 0, 4)} AS v FROM diag")
    r.cte("mean_paths", f"""SELECT e.asset, e.event_id, e.pos, e.direction, e.shock_score, list_reduce(list_concat([h.raw_history], list_transform(range(36), lambda i: [0.0])), lambda acc, x: list_append(acc, {smear})) AS path
      FROM shocks e JOIN lengths l USING (asset) JOIN raw_histories h ON h.asset = e.asset AND h.pos = e.pos WHERE e.pos >= 22 AND e.pos + 35 < n AND h.raw_history IS NOT NULL""")
    for name, source, ahead in (("median_response", "paths", "ahead"), ("mean_response", "mean_paths", "raw_ahead")):
        r.cte(name, f"""SELECT *, exp(abnormal_log_variance) - 1 AS abnormal_excess_variance FROM (SELECT p.asset, p.event_id, p.direction, p.shock_score, o.k AS "offset", a.v AS actual_variance, list_avg(p.path[22 + o.k + 1 : 22 + o.k + 5]) AS counterfactual_variance,
          ln(a.v / list_avg(p.path[22 + o.k + 1 : 22 + o.k + 5])) AS abnormal_log_variance FROM {source} p CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k) o JOIN {ahead} a ON a.asset = p.asset AND a.pos = p.pos + o.k WHERE a.v > 0)
          QUALIFY count(*) OVER (PARTITION BY asset, event_id) = 30""")
    feats = "forecast_log_variance log_daily log_weekly log_monthly pretrend".split()
    r.cte("features", "SELECT asset, pos, begin, shock_score, forecast_log_variance, h_daily AS log_daily, h_weekly AS log_weekly, h_monthly AS log_monthly, CASE WHEN past_energy > 0 THEN past_total / sqrt(past_energy) END AS pretrend FROM diag")
    r.cte("sound", "SELECT f.* FROM features f JOIN lengths USING (asset) WHERE pos <= n - 35 AND " + " AND ".join(f"{f} IS NOT NULL" for f in feats))
    r.cte("pool", "SELECT * FROM sound s WHERE shock_score <= 1 AND NOT EXISTS (SELECT 1 FROM shocks e WHERE e.asset = s.asset AND abs(e.pos - s.pos) <= 10)")
    r.cte("centres", "SELECT asset, " + ", ".join(f"median({f}) AS mid_{f}, stddev_pop({f}) AS std_{f}" for f in feats) + " FROM pool GROUP BY 1 HAVING count(*) >= 10")
    r.cte("spreads", "SELECT p.asset, " + ", ".join(f"CASE WHEN 1.4826 * median(abs(p.{f} - c.mid_{f})) > 0 THEN 1.4826 * median(abs(p.{f} - c.mid_{f})) WHEN any_value(c.std_{f}) > 0 THEN any_value(c.std_{f}) ELSE 1 END AS scale_{f}" for f in feats) + " FROM pool p JOIN centres c USING (asset) GROUP BY 1")
    square = " + ".join(f"pow((s.{f} - p.{f}) / m.scale_{f}, 2)" for f in feats)
    sides = ", ".join([*(f"s.{f} AS event_{f}" for f in feats), *(f"p.{f} AS control_{f}" for f in feats)])
    r.cte("meetings", f"""SELECT e.asset, e.event_id, e.pos AS event_position, e.direction, p.pos AS control_position, {sides}, sqrt({square}) + 0.25 * abs(e.pos - p.pos) / 504 AS distance, abs(e.pos - p.pos) <= 504 AS near
      FROM shocks e JOIN sound s ON s.asset = e.asset AND s.pos = e.pos JOIN spreads m ON m.asset = e.asset JOIN pool p ON p.asset = e.asset""")
    r.cte("matches", "SELECT *, row_number() OVER (PARTITION BY asset, event_id ORDER BY distance, control_position) AS control_rank FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY asset, event_id) AS local FROM meetings) WHERE near OR local < 10 QUALIFY control_rank <= 10")
    r.cte("matched_response", """SELECT *, exp(abnormal_log_variance) - 1 AS abnormal_excess_variance FROM (SELECT e.asset, e.event_id, e.direction, e.shock_score, c."offset", a.v AS actual_variance, c.counterfactual_variance, c.control_count, ln(a.v / c.counterfactual_variance) AS abnormal_log_variance
      FROM shocks e JOIN (SELECT m.asset, m.event_id, o.k AS "offset", exp(median(ln(a.v))) AS counterfactual_variance, count(*) AS control_count FROM matches m CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k) o JOIN ahead a ON a.asset = m.asset AND a.pos = m.control_position + o.k WHERE a.v > 0 GROUP BY ALL HAVING count(*) >= 5) c ON c.asset = e.asset AND c.event_id = e.event_id
      JOIN ahead a ON a.asset = e.asset AND a.pos = e.pos + c."offset" WHERE a.v > 0) QUALIFY count(*) OVER (PARTITION BY asset, event_id) = 30""")

    def summary(rows: str, method: str) -> str:
        v = "abnormal_excess_variance"
        return f"""SELECT *, '{method}' AS method FROM (SELECT asset, direction, "offset", avg({v}) AS mean, median({v}) AS median, quantile_cont({v}, 0.25) AS q25, quantile_cont({v}, 0.75) AS q75, count(*) AS count FROM {rows} GROUP BY ALL)
          JOIN (SELECT asset, direction, "offset", quantile_cont(s, 0.025) AS bootstrap_ci_low, quantile_cont(s, 0.975) AS bootstrap_ci_high FROM (SELECT d.asset, d.direction, sample, "offset", median({v}) AS s FROM ({draws(rows, 1729, 'asset, direction')}) d JOIN {rows} x ON x.asset = d.asset AND x.direction = d.direction AND x.event_id = d.event_id GROUP BY ALL) GROUP BY ALL) USING (asset, direction, "offset")"""

    r.cte("median_summary", summary("median_response", "har_conditional_median"))
    r.cte("matched_summary", summary("matched_response", "matched_controls"))

    key = "asset pos"
    r.add("h1_har_design", key, "target log_daily log_weekly log_monthly", lambda s, d: har.har_design(prox(s, d), q), "SELECT asset, pos, target, h_daily AS log_daily, h_weekly AS log_weekly, h_monthly AS log_monthly FROM lagged")
    r.add("h2_har_coefficients", "asset fit_pos", "har_const har_daily har_weekly har_monthly har_smearing", lambda s, d: har.fit_coefficients(prox(s, d), q), None, digits=5)
    r.add("h4_fixed_forecasts", key, "forecast_variance forecast_log_variance innovation", diag, "SELECT * FROM diag")
    r.add("h8_innovations", key, "actual_log_variance forecast_log_variance innovation innovation_scale shock_score", diag, "SELECT *, target AS actual_log_variance FROM diag", digits=7)
    r.add("h8_fitted_innovations", key, "forecast_log_variance innovation innovation_scale shock_score har_const har_smearing", lambda s, d: har.innovations(prox(s, d), q), None, digits=5)
    path = lambda smearing: lambda s, d: shocks(s, d).where("history is not null").select("asset", "pos", F.posexplode(har.recursive_path(F.col("history"), 10, smearing)).alias("step", "variance"))
    for name, source, smearing in (("h6_median_path", FORECAST, False), ("h7_mean_path", None, True)):
        body = f"exp({FORECAST.format(h='acc')})" + ("" if source else " * 1.3")
        r.add(name, "asset pos step", "variance", path(smearing), f"SELECT asset, pos, CAST(t.i - 1 AS INTEGER) AS step, path[22 + t.i] AS variance FROM (SELECT asset, pos, list_reduce(list_concat([history], list_transform(range(10), lambda i: [0.0])), lambda acc, x: list_append(acc, {body})) AS path FROM shocks WHERE history IS NOT NULL) CROSS JOIN (SELECT unnest(range(1, 11)) AS i) t", digits=10)
    ev = "asset event_id pos begin direction source"
    r.add("e1_volatility_shocks", ev, "close_return shock_score innovation forecast_variance threshold gap_share", shocks, "SELECT * FROM shocks", digits=7)
    r.add("e2_negative_shocks", "asset event_id pos", "shock_score", lambda s, d: events.filtered(shocks(s, d), "negative"), "SELECT * FROM shocks WHERE direction = 'negative'", digits=7)
    r.cte("past_sigma", f"SELECT *, abs(close_return) / nullif(sg, 0) AS return_score FROM (SELECT *, {full('stddev_pop', 'close_return', -60, -1)} AS sg FROM daily_logs)")
    r.add("e3_return_score", key, "past_sigma return_score", lambda s, d: events.return_score(prox(s, d), "close_return"), "SELECT *, sg AS past_sigma FROM past_sigma")
    r.add("e4_return_shocks", "asset event_id pos direction", "return_score threshold", lambda s, d: events.return_shocks(prox(s, d), "close_return"), f"SELECT *, CASE WHEN close_return < 0 THEN 'negative' ELSE 'positive' END AS direction FROM ({event_sql('past_sigma', 'return_score')})")
    r.cte("volatile", f"SELECT *, sqrt(252 * {full('avg', 'gap_rogers_satchell', -19, 0)}) AS volatility FROM prox")
    r.cte("peaks", event_sql("volatile", "volatility"))
    vol = lambda s, d: volatility.rolling_volatility(prox(s, d), q, 20)
    r.add("e5_volatility_peaks", "asset event_id pos", "volatility threshold", lambda s, d: events.volatility_peaks(vol(s, d), "volatility"), "SELECT * FROM peaks")
    r.add("e6_indicators", key, "negative_event positive_event", with_events(events.indicators), "SELECT d.asset, d.pos, CASE WHEN e.direction = 'negative' THEN 1 ELSE 0 END AS negative_event, CASE WHEN e.direction = 'positive' THEN 1 ELSE 0 END AS positive_event FROM diag d LEFT JOIN shocks e ON d.asset = e.asset AND d.pos = e.pos")
    resp = "actual_variance counterfactual_variance abnormal_log_variance abnormal_excess_variance"
    rk = "asset event_id direction offset"
    median_paths = with_events(responses.counterfactual_paths)
    r.add("r1_mean_counterfactual", rk, resp, with_events(lambda a, e: responses.counterfactual_paths(a, e, smearing=True, variance=q)), "SELECT * FROM mean_response", digits=7)
    r.add("r2_median_counterfactual", rk, resp, median_paths, "SELECT * FROM median_response", digits=7)
    r.add("r3_event_features", key, " ".join(feats), lambda s, d: responses.event_features(diag(s, d), energy=q), "SELECT * FROM features", digits=7)
    match = with_events(lambda a, e: responses.matched_controls(a, e, energy=q))
    r.add("r5_matched_controls", "asset event_id event_position direction control_rank control_position", "distance " + " ".join(f"{a}_{f}" for a in ("event", "control") for f in feats), match, "SELECT * FROM matches", digits=7)
    r.add("r6_matching_balance", "asset feature", "event_mean control_mean standardized_mean_difference mean_absolute_pair_difference", lambda s, d: responses.matching_balance(match(s, d)),
          "SELECT asset, feature, em AS event_mean, cm AS control_mean, CASE WHEN pooled > 0 THEN (em - cm) / pooled ELSE 0 END AS standardized_mean_difference, ad AS mean_absolute_pair_difference FROM (" + " UNION ALL ".join(f"SELECT asset, '{f}' AS feature, avg(event_{f}) AS em, avg(control_{f}) AS cm, sqrt((var_samp(event_{f}) + var_samp(control_{f})) / 2) AS pooled, avg(abs(event_{f} - control_{f})) AS ad FROM matches GROUP BY 1" for f in feats) + ")", digits=7)
    matched = with_events(lambda a, e: responses.matched_paths(a, e, responses.matched_controls(a, e, energy=q)))
    r.add("r7_matched_paths", rk + " control_count", resp, matched, "SELECT * FROM matched_response", digits=7)
    r.add("r8_forward_mean", key, "forward", lambda s, d: prox(s, d).withColumn("forward", responses.forward_mean(q, 3, 5)), f"SELECT asset, pos, {full('avg', q, 3, 7)} AS forward FROM prox", digits=10)
    lp = with_events(lambda a, e: responses.local_projections(a, e, energy=q))
    r.cte("projected", """SELECT b.asset, b.pos, year, CAST(direction = 'negative' AS DOUBLE) AS negative_event, CAST(direction = 'positive' AS DOUBLE) AS positive_event, forecast_log_variance, log_daily, log_weekly, log_monthly, pretrend, o.k AS "offset", ln(a.v + 1e-12) AS y FROM
      (SELECT f.*, CAST(year(f.begin) AS INTEGER) AS year, coalesce(e.direction, '') AS direction FROM features f LEFT JOIN shocks e ON e.asset = f.asset AND e.pos = f.pos JOIN (SELECT asset, any_value(threshold) AS bar FROM shocks GROUP BY 1) t ON t.asset = f.asset
       WHERE e.pos IS NOT NULL OR (NOT coalesce(f.shock_score >= bar, FALSE) AND NOT EXISTS (SELECT 1 FROM shocks c WHERE c.asset = f.asset AND abs(c.pos - f.pos) <= 10))) b
      CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k) o JOIN ahead a ON a.asset = b.asset AND a.pos = b.pos + o.k WHERE a.v IS NOT NULL AND """ + " AND ".join(f"{f} IS NOT NULL" for f in feats))
    r.cte("projected_counts", 'SELECT asset, "offset", count(*) AS nobs, CAST(sum(negative_event) AS BIGINT) AS negative_events, CAST(sum(positive_event) AS BIGINT) AS positive_events FROM projected GROUP BY ALL HAVING count(*) >= 400 AND least(sum(negative_event), sum(positive_event)) >= 8')
    r.cte("projectable", 'SELECT p.* FROM projected p SEMI JOIN projected_counts c ON c.asset = p.asset AND c."offset" = p."offset"')
    register_regression(r, "projections", "projectable", 'asset, "offset"', ["negative_event", "positive_event", *feats], 'greatest(4, "offset" + 3)', {n: [*w, *[0.0] * len(feats)] for n, w in responses.SIDES.items()}, years=True)
    one = lambda side, c: f"max({c}) FILTER (term = '{side}')"
    wide = ", ".join(f"{one(side, c)} AS {side if c == 'estimate' and side == 'difference' else f'{side}_{c}'}" for side in responses.SIDES for c in ("estimate", "std_error", "ci_low", "ci_high", "p_value"))
    r.cte("wide_projections", f'SELECT c.*, {wide}, any_value(r_squared) AS r_squared FROM projected_counts c JOIN projections p ON p.asset = c.asset AND p."offset" = c."offset" GROUP BY ALL')
    r.cte("projection_summary", " UNION ALL ".join(f"""SELECT asset, '{d}' AS direction, "offset", exp({d}_estimate) - 1 AS mean, exp({d}_estimate) - 1 AS median, exp({d}_ci_low) - 1 AS q25, exp({d}_ci_high) - 1 AS q75, {d}_events AS count, exp({d}_ci_low) - 1 AS bootstrap_ci_low, exp({d}_ci_high) - 1 AS bootstrap_ci_high, 'local_projection' AS method FROM wide_projections""" for d in ("negative", "positive")))
    r.add("r9_local_projections", "asset offset nobs negative_events positive_events", "negative_estimate negative_std_error positive_estimate positive_std_error difference difference_p_value r_squared", lp, "SELECT * FROM wide_projections", digits=6)
    r.add("r10_projection_summary", "asset direction offset", "median q25 q75", lambda s, d: responses.projection_summary(lp(s, d)), "SELECT * FROM projection_summary", digits=6)
    sm = "mean median q25 q75 bootstrap_ci_low bootstrap_ci_high"
    r.add("r11_median_summary", "asset direction offset count method", sm, lambda s, d: responses.response_summary(median_paths(s, d), SAMPLES), "SELECT * FROM median_summary", digits=7)
    r.add("r11_matched_summary", "asset direction offset count method", sm, lambda s, d: responses.response_summary(matched(s, d), SAMPLES), "SELECT * FROM matched_summary", digits=7)
    r.add("r12_event_horizon_values", "asset direction event_id", "value", lambda s, d: responses.event_horizon_values(median_paths(s, d), 1, 5), 'SELECT asset, direction, event_id, exp(avg(abnormal_log_variance)) - 1 AS value FROM median_response WHERE "offset" BETWEEN 1 AND 5 GROUP BY ALL', digits=7)
    def horizons(source: str) -> str:
        """The horizon comparisons of one method's responses."""
        parts = []
        for a, b in ((1, 5), (6, 10), (11, 20)):
            values = f"{source}_values_{a}"
            r.cte(values, f"""SELECT asset, direction, event_id, exp(avg(abnormal_log_variance)) - 1 AS value FROM {source} WHERE "offset" BETWEEN {a} AND {b} AND direction IN ('negative', 'positive') GROUP BY ALL""")
            parts.append(f"""SELECT '{a}-{b}' AS horizon, s.*, negative_median_excess - positive_median_excess AS negative_minus_positive, difference_ci_low, difference_ci_high, bootstrap_p_value FROM
              (SELECT asset, median(value) FILTER (direction = 'negative') AS negative_median_excess, median(value) FILTER (direction = 'positive') AS positive_median_excess, count(*) FILTER (direction = 'negative') AS negative_events, count(*) FILTER (direction = 'positive') AS positive_events FROM {values} GROUP BY 1) s
              JOIN (SELECT asset, quantile_cont(d, 0.025) AS difference_ci_low, quantile_cont(d, 0.975) AS difference_ci_high, least(1, 2 * least(avg(CAST(d <= 0 AS INTEGER)), avg(CAST(d >= 0 AS INTEGER)))) AS bootstrap_p_value FROM
                (SELECT w.asset, sample, median(value) FILTER (w.direction = 'negative') - median(value) FILTER (w.direction = 'positive') AS d FROM ({draws(values, 31415, 'asset, direction', HORIZON_SAMPLES)}) w JOIN {values} v ON v.asset = w.asset AND v.direction = w.direction AND v.event_id = w.event_id GROUP BY ALL) GROUP BY 1) USING (asset) WHERE negative_events >= 3 AND positive_events >= 3""")
        return " UNION ALL BY NAME ".join(parts)

    compared = "negative_median_excess positive_median_excess negative_minus_positive difference_ci_low difference_ci_high bootstrap_p_value"
    for name, of, source in (("r13_horizon_comparisons", median_paths, "median_response"), ("r13_matched_comparisons", matched, "matched_response")):
        r.add(name, "asset horizon negative_events positive_events", compared, lambda s, d, of=of: responses.horizon_comparisons(of(s, d), samples=HORIZON_SAMPLES), horizons(source), digits=7)
    both = lambda s, d: responses.response_summary(median_paths(s, d), SAMPLES).unionByName(responses.response_summary(matched(s, d), SAMPLES))
    r.add("r14_early_summary", "asset method direction positive_support minimum_events", "early_mean_excess", lambda s, d: responses.early_summary(both(s, d)),
          """SELECT asset, method, direction, avg(median) AS early_mean_excess, bool_or(bootstrap_ci_low > 0) AS positive_support, min(count) AS minimum_events FROM (SELECT asset, method, direction, "offset", median, bootstrap_ci_low, count FROM median_summary UNION ALL BY NAME SELECT asset, method, direction, "offset", median, bootstrap_ci_low, count FROM matched_summary) WHERE "offset" <= 5 GROUP BY ALL""", digits=7)
    r.add("r15_consensus", "asset allowed methods_positive methods_supported reason", "", lambda s, d: responses.consensus(responses.early_summary(both(s, d).unionByName(responses.projection_summary(lp(s, d))))), None)
    r.add("r16_aftershock_rates", "asset offset count exposed_events", "rate", with_events(responses.aftershock_rates),
          'SELECT e.asset, o.k AS "offset", avg(CAST(d.shock_score >= e.threshold AS INTEGER)) AS rate, count(*) FILTER (d.shock_score >= e.threshold) AS count, count(*) AS exposed_events FROM shocks e CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k) o JOIN diag d ON d.asset = e.asset AND d.pos = e.pos + o.k WHERE d.shock_score IS NOT NULL GROUP BY ALL')
    r.add("r17_aftershock_excess", "asset offset count exposed_events", "rate baseline_rate excess_rate rate_ratio aftershock_threshold", with_events(responses.aftershocks),
          """SELECT *, rate - baseline_rate AS excess_rate, rate / nullif(baseline_rate, 0) AS rate_ratio FROM (SELECT e.asset, o.k AS "offset", avg(CAST(d.shock_score >= b.t AS INTEGER)) AS rate, count(*) FILTER (d.shock_score >= b.t) AS count, count(*) AS exposed_events, any_value(b.t) AS aftershock_threshold, any_value(b.r) AS baseline_rate
          FROM shocks e CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k) o JOIN diag d ON d.asset = e.asset AND d.pos = e.pos + o.k JOIN (SELECT x.asset, any_value(t) AS t, avg(CAST(shock_score >= t AS INTEGER)) AS r FROM diag x JOIN (SELECT asset, quantile_cont(shock_score, 0.9) AS t FROM diag GROUP BY 1) y USING (asset) WHERE shock_score IS NOT NULL GROUP BY 1) b ON b.asset = e.asset WHERE d.shock_score IS NOT NULL GROUP BY ALL)""", digits=7)

    def study(s, d):
        rows = vol(s, d)
        return responses.event_study(rows, events.volatility_peaks(rows, "volatility"), "volatility")

    r.cte("study", f"""SELECT *, (volatility - baseline) / (peak - baseline) AS normalized_excess FROM (SELECT e.asset, e.event_id, e.pos AS event_position, o.k AS "offset", e.volatility AS peak, b.baseline, v.volatility FROM peaks e JOIN (SELECT asset, pos, {full('median', 'volatility', -20, -1, 1)} AS baseline FROM volatile) b ON b.asset = e.asset AND b.pos = e.pos
      JOIN (SELECT asset, max(pos) + 1 AS n FROM volatile GROUP BY 1) l ON l.asset = e.asset CROSS JOIN (SELECT CAST(unnest(range(-20, 61)) AS INTEGER) AS k) o JOIN volatile v ON v.asset = e.asset AND v.pos = e.pos + o.k WHERE e.pos >= 20 AND e.pos + 60 < n AND e.volatility - b.baseline > 0)""")
    r.add("r18_event_study", "asset event_id event_position offset", "volatility baseline normalized_excess", study, "SELECT * FROM study", digits=6)
    stats = lambda rows, v: f'SELECT asset, "offset", avg({v}) AS mean, median({v}) AS median, quantile_cont({v}, 0.25) AS q25, quantile_cont({v}, 0.75) AS q75, count({v}) AS count FROM {rows} GROUP BY ALL'
    r.add("r18_event_study_summary", "asset offset count", "mean median q25 q75", lambda s, d: responses.offset_summary(study(s, d), "normalized_excess"), stats("study", "normalized_excess"), digits=6)
    r.cte("return_shocks", event_sql("past_sigma", "return_score"))
    r.cte("squares", "SELECT *, close_return * close_return AS r2 FROM daily_logs")
    r.cte("forward", f"SELECT asset, pos, sqrt(252 * {full('avg', 'r2', -60, -1)}) AS baseline, sqrt(252 * {full('avg', 'r2', 1, 5)}) AS forward_volatility FROM squares")
    r.cte("forward_study", """SELECT e.asset, e.event_id, o.k AS "offset", b.baseline, f.forward_volatility, f.forward_volatility / b.baseline - 1 AS excess_ratio FROM return_shocks e JOIN forward b ON b.asset = e.asset AND b.pos = e.pos JOIN (SELECT asset, max(pos) + 1 AS n FROM daily_logs GROUP BY 1) l ON l.asset = e.asset
      CROSS JOIN (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS k) o JOIN forward f ON f.asset = e.asset AND f.pos = e.pos + o.k WHERE b.baseline > 0 AND f.forward_volatility IS NOT NULL AND e.pos + 65 < n""")
    fwd = lambda s, d: responses.forward_study(prox(s, d), events.return_shocks(prox(s, d), "close_return"), "close_return")
    r.add("r19_forward_study", "asset event_id offset", "baseline forward_volatility excess_ratio", fwd, "SELECT * FROM forward_study", digits=7)
    r.add("r19_forward_summary", "asset offset count", "mean median q25 q75", lambda s, d: responses.offset_summary(fwd(s, d), "excess_ratio"), stats("forward_study", "excess_ratio"), digits=7)
