"""Registered queries of loading, joining in time, streaming and exporting, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwell.functions import sketches
from shockwell.functions.storage import shared_dir
from shockwell.operators import events, hourly, quality, volatility
from shockwell.operators.asof import asof_join
from shockwell.plans.daily import PROXIES, full, logs_sql, proxy_sql
from shockwell.plans.registry import Registry
from shockwell.plans.shocks import FIXED, event_sql
from shockwell.sources import archives, candles, pages, payloads, sinks
from shockwell.streaming import scores

#: Size of the sketches that SQL can check: nothing is lost up to so many values in a group.
EXACT_SIZE = 65535
#: Consecutive orders of the table that go into payloads together: no payload has more rows, however many a month has.
PAGE = 5000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared ones, as a URI."""
    root = shared_dir(spark)
    return f"{root if ':' in root else 'file://' + root}/{name}-{uuid.uuid4().hex}"


def paged_daily(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "pages")
    pages.write_pages(candles.daily_candles(spark, sf_dir), path, 24, 100)
    return path


def market_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with blanks and lower case; boards are the shipping modes of each asset, of which AIR is the primary one."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    symbols = items.select(F.concat(F.lit(" "), F.lower("l_returnflag")).alias("symbol")).distinct()
    boards = items.groupBy(F.col("l_returnflag").alias("secid"), F.col("l_linestatus").alias("boardid")).agg(F.lit("stock").alias("engine"), F.lit("shares").alias("market"), F.count("*").alias("turn")).withColumn("is_primary", (F.col("boardid") == "O").cast("int"))
    return pages.load_market_data(symbols, boards, paged_daily(spark, sf_dir), "1995-01-01", "2000-06-30")


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each page of the table as a payload for each priority and month, and their rows again."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("page", F.floor(F.monotonically_increasing_id() / PAGE))
    row = F.array(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_orderstatus"))
    grouped = orders.groupBy("page", "o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.collect_list(row).alias("data"))
    body = F.to_json(F.struct(F.struct(F.array(F.lit("ORDERKEY"), F.lit("Price"), F.lit("status")).alias("columns"), "data").alias("history")))
    rows = payloads.payload_columns(grouped.select("o_orderpriority", body.alias("payload")), "history", ["orderkey", "price", "status"])
    return rows.select("o_orderpriority", F.col("orderkey").cast("long").alias("orderkey"), "status", F.col("price").cast("double").alias("price"))


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles in an archive for each three days, a member for each asset, and back."""
    path = fresh_path(spark, "archives")
    archives.write_candle_archives(candles.hourly_candles(spark, sf_dir), path, F.floor(F.dayofmonth("begin") / 3))
    return candles.positioned(archives.read_candle_archives(spark, f"{path}/*.zip"))


def exported(spark: SparkSession, rows: DataFrame, form: str) -> DataFrame:
    """All assets written, then the first asset's bars once more without the odd ones: the others keep what they have."""
    path = fresh_path(spark, "panel")
    sinks.write_panel(rows, path, form)
    first = rows.agg(F.min("asset")).first()[0]
    if first is not None:
        sinks.write_panel(rows.where((F.col("asset") == first) & (F.col("pos") % 2 == 0)), path, form)
    return sinks.read_panel(spark, path, rows.schema, form)


def online_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars in files of a quarter of the history each, streamed a file at a time."""
    name = "spark.sql.streaming.stateStore.providerClass"
    path, before = fresh_path(spark, "stream"), spark.conf.get(name)
    bars = volatility.variance_proxies(candles.daily_candles(spark, sf_dir)).select("asset", "pos", "begin", "gap_rogers_satchell")
    quarter = F.least(F.floor(F.col("pos") * 4 / (bars.agg(F.max("pos")).first()[0] or 1)), F.lit(3))
    for k in range(4):
        bars.where(quarter == k).coalesce(1).write.mode("append").parquet(f"{path}/bars")
    scores.use_state_store(spark)
    try:
        stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/bars")
        scored = scores.stream_shock_scores(stream, FIXED)
        scored.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/scores").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(scores.SCORED).parquet(f"{path}/scores")


def last_events(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    bought = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    other = rows.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("id"), "event_type", "value")
    return asof_join(bought, other, "ts", ["user_id"], ["id", "event_type", "value"], direction=direction, order=["id"], prefix="other_")


def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priority's last order of status F before each order of status P, at most a day before."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = rows.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    filled = rows.where("o_orderstatus = 'F'").select("o_orderpriority", "o_orderdate", F.col("o_orderkey").alias("key"), "o_totalprice")
    return asof_join(asked, filled, "o_orderdate", ["o_orderpriority"], ["key", "o_totalprice"], tolerance=86400, exact=False, order=["key"], prefix="last_", inner=True)


def register(r: Registry) -> None:
    key, ohlc = "asset pos begin", "open high low close volume value"
    prox = lambda s, d: volatility.variance_proxies(candles.daily_candles(s, d))

    r.add("s4_payload_rows", "o_orderpriority orderkey status", "price", payload_rows, "SELECT o_orderpriority, o_orderkey AS orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders")
    r.add("s8_paged_candles", "asset begin", ohlc, lambda s, d: pages.load_candles(s, paged_daily(s, d), "1996-02-03", "1999-05-05", 24, ["A", "N"]), "SELECT * FROM daily WHERE asset IN ('A', 'N') AND begin >= TIMESTAMP '1996-02-03' AND begin < TIMESTAMP '1999-05-06'")
    r.add("s9_archive_members", key, ohlc, archived, "SELECT * REPLACE (upper(asset) AS asset) FROM hourly")
    r.add("s10_market_data", "secid board engine market begin", ohlc, market_data,
          """SELECT asset AS secid, board, 'stock' AS engine, 'shares' AS market, begin, open, high, low, close, volume, value FROM daily JOIN (SELECT l_returnflag, l_linestatus AS board FROM (SELECT l_returnflag, l_linestatus, count(*) AS turn FROM lineitem GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, turn) = 1) ON l_returnflag = asset WHERE begin >= TIMESTAMP '1995-01-01' AND begin < TIMESTAMP '2000-07-01'""")
    gap = "coalesce(date_diff('microsecond', lag(begin) OVER (PARTITION BY asset ORDER BY pos), begin) / 86400000000.0 > 2, FALSE)"
    r.cte("export_logs", logs_sql("daily", gap))
    r.cte("export_prox", "SELECT *, gap AS far FROM (" + proxy_sql("export_logs", 20) + ")")
    r.add("k1_daily_export", key, f"{ohlc} {PROXIES} raw_log_return cleaned_log_return", lambda s, d: exported(s, sinks.daily_export(candles.daily_candles(s, d), 2), "csv"),
          "SELECT p.*, l.close_return AS raw_log_return, CASE WHEN NOT p.far THEN l.close_return END AS cleaned_log_return FROM (SELECT * FROM export_prox) p JOIN daily_logs l ON l.asset = p.asset AND l.pos = p.pos WHERE p.asset <> (SELECT min(asset) FROM daily) OR p.pos % 2 = 0")
    r.add("k2_hourly_export", f"{key} date hour regular_session", f"{ohlc} log_return_oc price_increment", lambda s, d: exported(s, quality.prepared_hourly(candles.hourly_candles(s, d), 0, 23).select("asset", "pos", "begin", *ohlc.split(), "date", "hour", "regular_session", "log_return_oc", "price_increment"), "parquet"),
          "SELECT * FROM prepared WHERE asset <> (SELECT min(asset) FROM prepared) OR pos % 2 = 0")
    r.add("c12_prepared_asset", key, "log_return_oc scale_mad conditional_scale z_return m2_instant m3_instant", lambda s, d: hourly.prepared_asset(candles.hourly_candles(s, d), 0, 23, 20, 8), "SELECT * FROM z", digits=7)
    r.add("h8_online_scores", key, "actual_log_variance forecast_log_variance innovation innovation_scale shock_score", online_scores, "SELECT *, target AS actual_log_variance FROM diag", digits=7)

    matched = "other_matched_ts AS other_ts"
    for name, direction, sign in (("j1_last_event", "backward", ">="), ("j2_next_event", "forward", "<=")):
        r.add(name, "event_id user_id other_id other_event_type other_ts", "other_value", lambda s, d, direction=direction: last_events(s, d, direction).withColumnRenamed(*matched.split(" AS ")),
              f"SELECT l.event_id, l.user_id, r.event_id AS other_id, r.event_type AS other_event_type, r.ts AS other_ts, r.value AS other_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') r ON l.user_id = r.user_id AND l.ts {sign} r.ts")
    r.add("j3_recent_order", "o_orderkey o_orderpriority o_orderdate last_key", "last_o_totalprice", last_orders,
          """SELECT l.*, r.last_key, r.last_o_totalprice FROM (SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'P') l ASOF JOIN (SELECT o_orderpriority, o_orderdate, max(o_orderkey) AS last_key, arg_max(o_totalprice, o_orderkey) AS last_o_totalprice
          FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) r ON l.o_orderpriority = r.o_orderpriority AND l.o_orderdate > r.o_orderdate WHERE l.o_orderdate - r.o_orderdate <= INTERVAL 1 DAY""")

    r.add("q1_sketched_thresholds", "l_returnflag n", "threshold", lambda s, d: sketches.sketched_thresholds(s.read.parquet(f"{d}/lineitem.parquet").withColumn("slice", F.year("l_shipdate")), "l_extendedprice", ["l_returnflag"], 0.99, EXACT_SIZE, slices="slice"),
          "SELECT l_returnflag, count(*) AS n, quantile_disc(l_extendedprice, 0.99) AS threshold FROM lineitem GROUP BY 1")
    r.add("q2_sketched_deviations", "o_orderpriority n", "median mad", lambda s, d: sketches.median_absolute_deviation(s.read.parquet(f"{d}/orders.parquet"), "o_totalprice", ["o_orderpriority"], EXACT_SIZE),
          "SELECT o_orderpriority, count(*) AS n, any_value(m) AS median, quantile_disc(abs(o_totalprice - m), 0.5) AS mad FROM (SELECT *, quantile_disc(o_totalprice, 0.5) OVER (PARTITION BY o_orderpriority) AS m FROM orders) GROUP BY 1")
    r.add("e1_sketched_shocks", "asset event_id pos", "return_score threshold", lambda s, d: events.suppressed(events.return_score(prox(s, d), "close_return"), "return_score", 0.95, 10, EXACT_SIZE), event_sql("past_sigma", "return_score", "quantile_disc"))
    names = volatility.PROXIES
    mids, rels = ", ".join(f"{n} / nullif(quantile_disc({n}, 0.5) OVER (PARTITION BY asset), 0) AS r_{n}" for n in names), ", ".join(f"r_{n}" for n in names)
    r.add("v8_sketched_disagreement", f"{key} rank", "disagreement", lambda s, d: volatility.proxy_disagreement(prox(s, d), sketch=EXACT_SIZE),
          f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY disagreement DESC NULLS LAST, pos) AS rank FROM (SELECT *, greatest({rels}) - least({rels}) AS disagreement FROM (SELECT *, {mids} FROM prox)) WHERE disagreement IS NOT NULL QUALIFY rank <= 20")
    r.add("h1_sketched_scale", key, "scale_mad", lambda s, d: hourly.standardised(quality.prepared_hourly(candles.hourly_candles(s, d), 0, 23), 20, 8, sketch=EXACT_SIZE),
          f"SELECT *, coalesce({full('median', 'ar', -20, -1, 8).replace('PARTITION BY asset ', 'PARTITION BY asset, hour ')} / 0.67448975, greatest(quantile_disc(ar, 0.5) OVER (PARTITION BY asset, hour) / 0.67448975, 1e-8)) AS scale_mad FROM (SELECT *, abs(log_return_oc) AS ar FROM prepared)")
