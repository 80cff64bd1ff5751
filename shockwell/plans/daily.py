"""Queries over daily candles: quality, volatility, moments and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockwell.operators import quality, trend, volatility
from shockwell.plans.registry import Registry
from shockwell.plans.regression_sql import register_regression
from shockwell.sources import candles

FLAGS = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
PROXIES = " ".join(volatility.PROXY_COLUMNS)


def full(fn: str, x: str, low: int, high: int, least: int | None = None) -> str:
    """fn(x) over rows around each row, null with too few values."""
    bound = lambda n: f"{-n} PRECEDING" if n < 0 else "CURRENT ROW" if n == 0 else f"{n} FOLLOWING"
    over = f"OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN {bound(low)} AND {bound(high)})"
    return f"CASE WHEN count({x}) {over} >= {high - low + 1 if least is None else least} THEN {fn.format(x=x) if '{' in fn else f'{fn}({x})'} {over} END"


def candle_sql(table: str, asset: str, begin: str, price: str, quantity: str, order: str) -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY asset ORDER BY begin) - 1 AS INTEGER) AS pos FROM (
      SELECT {asset} AS asset, {begin} AS begin, arg_min({price}, {order}) AS open, max({price}) AS high, min({price}) AS low,
        arg_max({price}, {order}) AS close, sum({quantity}) AS volume, sum({price}) AS value FROM {table} WHERE {price} > 0 GROUP BY ALL)"""


def logs_sql(source: str, gap: str = "FALSE") -> str:
    lead = "OVER (PARTITION BY asset ORDER BY pos)"
    return f"""SELECT *, CASE WHEN NOT gap THEN lc - prev END AS close_return, CASE WHEN NOT gap THEN lo - prev END AS overnight_return,
      lc - lo AS open_to_close_return, greatest((lh - lo) * (lh - lc) + (ll - lo) * (ll - lc), 0) AS rogers_satchell
      FROM (SELECT *, ln(open) AS lo, ln(high) AS lh, ln(low) AS ll, ln(close) AS lc, lag(ln(close)) {lead} AS prev, {gap} AS gap FROM {source})"""


def proxy_sql(source: str, center: int) -> str:
    k = 0.34 / (1.34 + (center + 1) / (center - 1))
    return f"""SELECT *, close_return * close_return AS close_to_close, (lh - ll) * (lh - ll) / (4 * ln(2)) AS parkinson,
      greatest(0.5 * (lh - ll) * (lh - ll) - (2 * ln(2) - 1) * open_to_close_return * open_to_close_return, 0) AS garman_klass,
      overnight_return * overnight_return + rogers_satchell AS gap_rogers_satchell, overnight_return * overnight_return AS overnight_gap_squared,
      rogers_satchell AS intraday_rs,
      (overnight_return - mo) * (overnight_return - mo) + {k} * (open_to_close_return - mi) * (open_to_close_return - mi) + (1 - {k}) * rogers_satchell AS yang_zhang_contribution
      FROM (SELECT *, {full('avg', 'overnight_return', -center, -1)} AS mo, {full('avg', 'open_to_close_return', -center, -1)} AS mi FROM {source})"""


def bucket_sql(x: str, groups: int, by: str, source: str) -> str:
    edges = ", ".join(str(k / groups) for k in range(groups + 1))
    return f"SELECT *, greatest(len(list_filter(list_distinct(quantile_cont({x}, [{edges}]) OVER (PARTITION BY {by})), lambda e: e < {x})), 1) AS bucket FROM {source}"


def register(r: Registry) -> None:
    r.cte("daily", candle_sql("lineitem", "l_returnflag", "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)", "l_extendedprice", "l_quantity", FLAGS))
    r.cte("pooled", candle_sql("lineitem", "'ALL'", "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)", "l_extendedprice", "l_quantity", FLAGS))
    r.cte("sparse", candle_sql("orders", "o_orderpriority", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)", "o_totalprice", "1.0", "o_orderkey"))
    r.cte("daily_logs", logs_sql("daily"))
    r.cte("prox", proxy_sql("daily_logs", 20))
    gap = "coalesce(date_diff('microsecond', lag(begin) OVER (PARTITION BY asset ORDER BY pos), begin) / 86400000000.0 > 2, FALSE)"
    r.cte("sparse_logs", logs_sql("sparse", gap))
    r.cte("sparse_prox", proxy_sql("sparse_logs", 20))

    daily, sparse = candles.daily_candles, candles.sparse_daily_candles
    prox = lambda s, d: volatility.variance_proxies(daily(s, d))
    key = "asset pos begin"

    r.add("s8_daily_candles", key, "open high low close volume value", daily, "SELECT * FROM daily")
    r.add("s8_sparse_candles", key, "open high low close volume value", sparse, "SELECT * FROM sparse")
    r.add("s2_normalized_symbols", "raw symbol", "", lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit(" "), "p_brand").alias("raw"), candles.normalized_symbol(F.concat(F.lit(" "), "p_brand")).alias("symbol")).distinct(),
          "SELECT DISTINCT ' ' || p_brand AS raw, CASE upper(trim(p_brand)) WHEN 'USDRUB_TOM' THEN 'USD000UTSTOM' ELSE upper(trim(p_brand)) END AS symbol FROM part")
    listed = lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("secid"), F.col("p_name").alias("shortname"), (F.col("p_size") % 2).alias("is_traded"))
    r.add("s5_search_securities", "secid shortname is_traded", "", lambda s, d: candles.search_securities(listed(s, d), "1", 25),
          "SELECT CAST(p_partkey AS VARCHAR) AS secid, p_name AS shortname, p_size % 2 AS is_traded FROM part WHERE contains(lower(CAST(p_partkey AS VARCHAR)), '1') OR contains(lower(p_name), '1') ORDER BY is_traded DESC NULLS LAST, secid LIMIT 25")
    boards = lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("secid"), F.col("s_name").alias("boardid"), F.lit("stock").alias("engine"), F.lit("shares").alias("market"), (F.col("s_acctbal") > 9000).cast("int").alias("is_primary"), F.col("s_suppkey").alias("turn"))
    r.add("s7_resolve_route", "secid boardid engine market is_primary", "", lambda s, d: candles.resolve_route(boards(s, d)),
          "SELECT s_nationkey AS secid, s_name AS boardid, 'stock' AS engine, 'shares' AS market, CAST(s_acctbal > 9000 AS INTEGER) AS is_primary FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 9000 THEN 0 ELSE 1 END, s_suppkey) = 1")

    r.add("c4_quality_report", "asset rule violations", "", lambda s, d: quality.quality_report(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").alias("begin"), F.col("o_totalprice").alias("open"), (F.col("o_totalprice") - 1000).alias("high"), F.lit(2000.0).alias("low"), F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice")).alias("close"))),
          """SELECT asset, rule, violations FROM (SELECT o_orderpriority AS asset, count(*) FILTER (o_orderstatus = 'P') AS null_close,
          count(*) FILTER (o_totalprice <= 0 OR o_totalprice - 1000 <= 0) AS nonpositive_price, count(o_orderdate) - count(DISTINCT o_orderdate) AS duplicate_begin,
          count(*) FILTER (o_totalprice - 1000 < greatest(o_totalprice, 2000)) AS high_below_body,
          count(*) FILTER (2000 > least(o_totalprice, o_totalprice - 1000)) AS low_above_body FROM orders GROUP BY 1)
          UNPIVOT (violations FOR rule IN (null_close, nonpositive_price, duplicate_begin, high_below_body, low_above_body))""")
    r.add("c5_calendar_gaps", "asset previous_timestamp timestamp", "gap_days log_return", lambda s, d: quality.calendar_gaps(sparse(s, d), 2),
          """SELECT asset, p AS previous_timestamp, begin AS timestamp, g AS gap_days, ln(close) - pc AS log_return FROM (SELECT *, lag(begin) OVER w AS p, lag(ln(close)) OVER w AS pc,
          date_diff('microsecond', lag(begin) OVER w, begin) / 86400000000.0 AS g FROM sparse WINDOW w AS (PARTITION BY asset ORDER BY pos)) WHERE g > 2""")
    r.add("c7_log_returns", key, "log_return", lambda s, d: quality.log_returns(sparse(s, d), max_gap_days=2), "SELECT *, close_return AS log_return FROM sparse_logs")
    r.add("c8_without_unfinished", key + " dropped", "close", lambda s, d: quality.without_unfinished(sparse(s, d), "2001-08-01"),
          "SELECT * FROM (SELECT *, bool_or(o) OVER (PARTITION BY asset) AS dropped FROM (SELECT *, pos = max(pos) OVER (PARTITION BY asset) AND begin >= TIMESTAMP '2001-08-01' AS o FROM sparse)) WHERE NOT o")
    r.add("c11_display_columns", "asset bars has_volume", "", lambda s, d: quality.display_columns(daily(s, d)), "SELECT asset, count(*) AS bars, max(abs(coalesce(volume, 0))) > 0 AS has_volume FROM daily GROUP BY 1")

    r.add("v1_variance_proxies", key, PROXIES, prox, "SELECT * FROM prox")
    r.add("v1_variance_proxies_gapped", key, PROXIES, lambda s, d: volatility.variance_proxies(sparse(s, d), max_gap_days=2), "SELECT * FROM sparse_prox")
    r.add("v2_rolling_volatility", key, "volatility", lambda s, d: volatility.rolling_volatility(prox(s, d), "gap_rogers_satchell", 20), f"SELECT *, sqrt(252 * {full('avg', 'gap_rogers_satchell', -19, 0)}) AS volatility FROM prox")
    r.add("v3_yang_zhang_volatility", key, "yang_zhang_volatility", lambda s, d: volatility.yang_zhang_volatility(daily(s, d), 20),
          f"SELECT *, sqrt(252 * CASE WHEN v IS NULL THEN NULL ELSE greatest(v, 0) END) AS yang_zhang_volatility FROM (SELECT *, {full('var_samp', 'overnight_return', -19, 0)} + {0.34 / (1.34 + 21 / 19)} * {full('var_samp', 'open_to_close_return', -19, 0)} + {1 - 0.34 / (1.34 + 21 / 19)} * {full('avg', 'rogers_satchell', -19, 0)} AS v FROM daily_logs)")
    r.add("v4_close_to_close_volatility", key, "close_to_close_volatility", lambda s, d: volatility.close_to_close_volatility(quality.log_returns(daily(s, d)), "log_return", 20), f"SELECT *, sqrt(252 * {full('var_pop', 'close_return', -19, 0)}) AS close_to_close_volatility FROM daily_logs")
    r.cte("numbered_returns", "SELECT asset, pos, close_return AS x, max(CASE WHEN close_return IS NOT NULL THEN pos END) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_pos FROM sparse_logs")
    r.cte("folded", """SELECT asset, pos, CAST(NULL AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v, 0 AS n FROM numbered_returns WHERE pos = 0 AND x IS NULL
      UNION ALL SELECT r.asset, r.pos,
        CASE WHEN r.x IS NULL THEN f.m WHEN f.m IS NULL THEN r.x ELSE f.m + w * (r.x - f.m) END,
        CASE WHEN r.x IS NULL THEN f.v WHEN f.m IS NULL THEN 0 ELSE (1 - w) * (f.v + w * (r.x - f.m) * (r.x - f.m)) END,
        f.n + CASE WHEN r.x IS NULL THEN 0 ELSE 1 END
      FROM folded f JOIN (SELECT *, (2.0 / 21) / (pow(1 - 2.0 / 21, pos - coalesce(last_pos, pos - 1)) + 2.0 / 21) AS w FROM numbered_returns) r ON r.asset = f.asset AND r.pos = f.pos + 1""")
    r.add("v5_ewma_volatility", "asset pos", "ewma_volatility", lambda s, d: volatility.ewma_volatility(quality.log_returns(sparse(s, d), max_gap_days=2), "log_return", 20),
          "SELECT asset, pos, CASE WHEN n >= 20 THEN sqrt(252 * v) END AS ewma_volatility FROM folded")
    r.add("v6_parkinson_volatility", key, "parkinson_volatility", lambda s, d: volatility.parkinson_volatility(daily(s, d), 20), f"SELECT *, sqrt(252 * {full('avg', 'g', -19, 0)} / (4 * ln(2))) AS parkinson_volatility FROM (SELECT *, ln(high / low) * ln(high / low) AS g FROM daily)")
    names = volatility.PROXIES
    pairs = " UNION ALL ".join(f"SELECT asset, '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM prox WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for k, a in enumerate(names) for b in names[k:])
    rank = lambda v: f"rank() OVER (PARTITION BY asset, a, b ORDER BY {v}) + (count(*) OVER (PARTITION BY asset, a, b, {v}) - 1) / 2.0"
    r.add("v7_proxy_correlations", "asset a b", "rho", lambda s, d: volatility.proxy_correlations(prox(s, d)), f"SELECT asset, a, b, corr(rx, ry) AS rho FROM (SELECT asset, a, b, {rank('x')} AS rx, {rank('y')} AS ry FROM ({pairs})) GROUP BY ALL")
    mids = ", ".join(f"{n} / nullif(median({n}) OVER (PARTITION BY asset), 0) AS r_{n}" for n in names)
    rels = ", ".join(f"r_{n}" for n in names)
    r.add("v8_proxy_disagreement", key + " rank", "disagreement " + " ".join(names), lambda s, d: volatility.proxy_disagreement(prox(s, d)),
          f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY disagreement DESC NULLS LAST, pos) AS rank FROM (SELECT *, greatest({rels}) - least({rels}) AS disagreement FROM (SELECT *, {mids} FROM prox)) WHERE disagreement IS NOT NULL QUALIFY rank <= 20", digits=6)
    r.add("v9_rolling_asymmetry", key, "downside_variance_share downside_upside_log_ratio quantile_skewness", lambda s, d: volatility.rolling_asymmetry(quality.log_returns(daily(s, d)), "log_return", 20),
          f"""SELECT *, dn / nullif(dn + up, 0) AS downside_variance_share, ln((dn + 2.220446049250313e-16) / (up + 2.220446049250313e-16)) AS downside_upside_log_ratio,
          CASE WHEN q75 - q25 > 0 THEN (q75 + q25 - 2 * q50) / (q75 - q25) END AS quantile_skewness FROM (SELECT *,
          {full('sum', 'd2', -19, 0)} AS dn, {full('sum', 'u2', -19, 0)} AS up, {full('quantile_cont({x}, 0.25)', 'close_return', -19, 0)} AS q25, {full('quantile_cont({x}, 0.5)', 'close_return', -19, 0)} AS q50, {full('quantile_cont({x}, 0.75)', 'close_return', -19, 0)} AS q75
          FROM (SELECT *, CASE WHEN close_return < 0 THEN close_return * close_return ELSE 0 END AS d2, CASE WHEN close_return > 0 THEN close_return * close_return ELSE 0 END AS u2 FROM daily_logs))""", digits=6)
    r.cte("windowed", f"SELECT *, {full('avg', 'close_return', -19, 0)} AS mu, {full('list', 'close_return', -19, 0)} AS xs FROM daily_logs")
    r.cte("moments", "SELECT *, list_sum(list_transform(xs, lambda x: pow(x - mu, 2))) / 20 AS m2, list_sum(list_transform(xs, lambda x: pow(x - mu, 3))) / 20 AS m3 FROM windowed")
    moments = lambda s, d: volatility.rolling_moments(quality.log_returns(daily(s, d)), "log_return", 20)
    r.add("v10_rolling_moments", key, "rolling_mean m2 m3 signed_cuberoot_m3 skewness", moments, "SELECT *, mu AS rolling_mean, sign(m3) * cbrt(abs(m3)) AS signed_cuberoot_m3, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END AS skewness FROM moments")
    r.add("v11_clipped_moment", key, "m3_clipped", lambda s, d: volatility.clipped_moment(moments(s, d)), "SELECT *, CASE WHEN m3 IS NOT NULL THEN greatest(least(m3, quantile_cont(m3, 0.99) OVER (PARTITION BY asset)), quantile_cont(m3, 0.01) OVER (PARTITION BY asset)) END AS m3_clipped FROM moments")
    r.add("v12_overnight_intraday", key, "overnight_gap_squared intraday_rs", prox, "SELECT * FROM prox")

    # Trend
    r.cte("states", f"""SELECT *, CASE WHEN q > 0 THEN ln(q + 1e-12) END AS log_daily, CASE WHEN m5 IS NOT NULL THEN ln(m5 + 1e-12) END AS log_weekly, CASE WHEN m22 IS NOT NULL THEN ln(m22 + 1e-12) END AS log_monthly
      FROM (SELECT *, {full('avg', 'qp', -4, 0)} AS m5, {full('avg', 'qp', -21, 0)} AS m22, {full('avg', 'qn', 1, 5)} AS future_variance, {full('sum', 'close_return', -19, 0)} AS total, {full('sum', 'qn', -19, 0)} AS energy
      FROM (SELECT *, gap_rogers_satchell AS q, CASE WHEN gap_rogers_satchell > 0 THEN gap_rogers_satchell END AS qp, CASE WHEN gap_rogers_satchell >= 0 THEN gap_rogers_satchell END AS qn FROM prox))""")
    r.cte("trend", "SELECT * FROM (SELECT asset, pos, begin, total / sqrt(energy) AS normalized_trend, log_daily, log_weekly, log_monthly, future_variance, sqrt(252 * future_variance) AS future_volatility FROM states WHERE energy > 0) WHERE normalized_trend IS NOT NULL AND log_daily IS NOT NULL AND log_weekly IS NOT NULL AND log_monthly IS NOT NULL AND future_variance IS NOT NULL")
    frame = lambda s, d: trend.trend_frame(prox(s, d), "close_return", "gap_rogers_satchell", 20, 5)
    r.add("t1_cumulative_trend", key, "cumulative_trend", lambda s, d: trend.cumulative_trend(prox(s, d), "close_return", 20), "SELECT *, total AS cumulative_trend FROM states")
    r.add("t2_normalized_trend", key, "normalized_trend", lambda s, d: trend.normalized_trend(prox(s, d), "close_return", 20, "gap_rogers_satchell"), "SELECT *, CASE WHEN energy > 0 THEN total / sqrt(energy) END AS normalized_trend FROM states")
    r.add("t3_future_variance", key, "future_variance", lambda s, d: trend.future_variance(prox(s, d), "gap_rogers_satchell", 5), "SELECT * FROM states")
    r.add("t4_har_state", key, "log_daily log_weekly log_monthly", lambda s, d: trend.har_state(prox(s, d), "gap_rogers_satchell"), "SELECT * FROM states")
    columns = "normalized_trend log_daily log_weekly log_monthly future_variance future_volatility"
    r.add("t5_trend_frame", key, columns, frame, "SELECT * FROM trend")
    r.add("t7_correlations", "asset observations", "pearson spearman", lambda s, d: trend.correlations(frame(s, d)),
          "SELECT asset, count(*) AS observations, corr(normalized_trend, future_volatility) AS pearson, corr(ra, rb) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY asset ORDER BY normalized_trend) + (count(*) OVER (PARTITION BY asset, normalized_trend) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY asset ORDER BY future_volatility) + (count(*) OVER (PARTITION BY asset, future_volatility) - 1) / 2.0 AS rb FROM trend) GROUP BY 1")
    r.add("t8_deciles", "asset bucket observations", "trend_mean future_vol_mean future_vol_median", lambda s, d: trend.deciles(frame(s, d)),
          f"SELECT asset, CAST(bucket AS INTEGER) AS bucket, count(*) AS observations, avg(normalized_trend) AS trend_mean, avg(future_volatility) AS future_vol_mean, median(future_volatility) AS future_vol_median FROM ({bucket_sql('normalized_trend', 10, 'asset', 'trend')}) GROUP BY ALL")
    r.add("t9_realized_volatility", key, "current_volatility future_volatility", lambda s, d: trend.realized_volatility(prox(s, d), "close_return", 20, 5),
          f"SELECT *, sqrt(252 * {full('avg', 'r2', -19, 0)}) AS current_volatility, sqrt(252 * {full('avg', 'r2', 1, 5)}) AS future_volatility FROM (SELECT *, close_return * close_return AS r2 FROM daily_logs)")
    r.cte("design", "SELECT *, ln(future_variance) AS y, greatest(-normalized_trend, 0) AS negative_trend, greatest(normalized_trend, 0) AS positive_trend FROM trend WHERE future_variance > 0")
    r.add("t10_regression_design", key, "y negative_trend positive_trend", lambda s, d: trend.regression_design(frame(s, d)), "SELECT * FROM design")
    terms = ["log_daily", "log_weekly", "log_monthly", "negative_trend", "positive_trend"]
    sums = ", ".join(f"sum({a} * {b}) AS s_{a}_{b}" for k, a in enumerate([*terms, "y"]) for b in [*terms, "y"][k:])
    r.add("t11_normal_equations", "asset n", " ".join(f"s_{a}_{b}" for k, a in enumerate([*terms, "y"]) for b in [*terms, "y"][k:]), lambda s, d: trend.normal_equations(trend.regression_design(frame(s, d)), terms), f"SELECT asset, count(*) AS n, {sums} FROM design GROUP BY 1", digits=4)
    columns = ["const", *terms]
    contrasts = {n: [float(n == m) for m in columns] for n in columns} | {"difference_down_minus_up": [0.0] * 4 + [1.0, -1.0]}
    r.cte("design_all", "SELECT *, 'all' AS period, 1.0 AS const FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS held FROM design) WHERE held >= 120")
    register_regression(r, "regression", "design_all", "asset, period", columns, "5", contrasts)
    r.cte("design_periods", "SELECT * FROM (SELECT *, 1.0 AS const, count(*) OVER (PARTITION BY asset, period) AS held FROM design JOIN (VALUES ('first', DATE '1995-01-01', DATE '1997-12-31'), ('middle', DATE '1998-01-01', DATE '1999-12-31'), ('last', DATE '2000-01-01', DATE '2001-12-31')) v(period, since, until) ON CAST(begin AS DATE) BETWEEN since AND until) WHERE held >= 80")
    register_regression(r, "period_regression", "design_periods", "asset, period", columns, "5", contrasts)
    errors = "estimate std_error p_value ci_low ci_high"
    r.add("t12_har_trend_regression", "asset observations term", f"{errors} full_r_squared", lambda s, d: trend.fit_regressions(frame(s, d), hac_lags=5), "SELECT *, n AS observations, r_squared AS full_r_squared FROM regression", digits=6)
    r.add("t13_regression_by_period", "asset period observations term", errors, lambda s, d: trend.fit_regressions_by_period(frame(s, d)), "SELECT *, n AS observations FROM period_regression", digits=6)
    r.add("t15_qlike", "asset", "qlike", lambda s, d: trend.qlike(frame(s, d).withColumn("forecast", F.exp("log_monthly")), "future_variance", "forecast"), "SELECT asset, avg(future_variance / f - ln(future_variance / f) - 1) AS qlike FROM (SELECT *, exp(log_monthly) AS f FROM trend) WHERE future_variance > 0 GROUP BY 1")
    r.add("t16_walk_forward", "asset test_year train_n test_n", "baseline_qlike full_qlike delta_qlike_full_minus_baseline baseline_log_mse full_log_mse delta_log_mse_full_minus_baseline", lambda s, d: trend.walk_forward(frame(s, d)), None, digits=6)
    r.add("t17_interpretation", "asset interpretation", "", lambda s, d: trend.interpretation(trend.fit_regressions(frame(s, d), hac_lags=5)),
          """SELECT asset, format('falling trend: {:+.1f}% variance, {:+.1f}% volatility ({}); rising trend: {:+.1f}% variance, {:+.1f}% volatility ({})', 100 * (exp(d) - 1), 100 * (exp(d / 2) - 1), CASE WHEN pd < 0.05 THEN 'resolved' ELSE 'not resolved' END, 100 * (exp(u) - 1), 100 * (exp(u / 2) - 1), CASE WHEN pu < 0.05 THEN 'resolved' ELSE 'not resolved' END) AS interpretation
          FROM (SELECT asset, max(estimate) FILTER (term = 'negative_trend') AS d, max(p_value) FILTER (term = 'negative_trend') AS pd, max(estimate) FILTER (term = 'positive_trend') AS u, max(p_value) FILTER (term = 'positive_trend') AS pu FROM regression GROUP BY 1)""")
    r.add("t18_legacy_regression", "asset observations term", "estimate", lambda s, d: trend.fit_legacy(trend.realized_volatility(trend.normalized_trend(prox(s, d), "close_return", 20), "close_return", 20, 5)), None, digits=5)
    # Sets, rollups and pivots of the panel
    r.add("x1_rollup_bars", "asset year bars", "mean_volume", lambda s, d: daily(s, d).withColumn("year", F.year("begin")).rollup("asset", "year").agg(F.count("*").alias("bars"), F.avg("volume").alias("mean_volume")),
          "SELECT asset, CAST(year(begin) AS INTEGER) AS year, count(*) AS bars, avg(volume) AS mean_volume FROM daily GROUP BY ROLLUP (asset, year(begin))")
    r.add("x2_days_without_orders", "begin", "", lambda s, d: daily(s, d).select("begin").distinct().exceptAll(sparse(s, d).where("asset = '1-URGENT'").select("begin")), "SELECT DISTINCT begin FROM daily EXCEPT SELECT begin FROM sparse WHERE asset = '1-URGENT'")
