"""Closed-form cases of the engine's operators on small frames."""

import datetime as dt
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockwell.functions import numeric
from shockwell.functions.columns import require_columns
from shockwell.operators import decay, events, har, hourly, quality, responses, trend, volatility
from shockwell.sources import candles

DAY = dt.datetime(2022, 1, 3)


def frame(spark, close, **others):
    rows = [("a", k, DAY + dt.timedelta(days=k), float(c), float(c), float(c), float(c), 1.0) for k, c in enumerate(close)]
    df = spark.createDataFrame(rows, "asset string, pos int, begin timestamp_ntz, open double, high double, low double, close double, volume double")
    for name, values in others.items():
        own = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], f"pos int, {name} double")
        df = df.drop(name).join(own, "pos")
    return df


def column(df, name):
    return [r[0] for r in df.orderBy("pos").select(name).collect()]


def test_log_returns_and_gaps(spark):
    assert column(quality.log_returns(frame(spark, [100, 110, 121])), "log_return") == pytest.approx([None, math.log(1.1), math.log(1.1)])
    rows = [("a", 0, dt.datetime(2022, 2, 25), 100.0), ("a", 1, dt.datetime(2022, 3, 24), 50.0), ("a", 2, dt.datetime(2022, 3, 25), 55.0)]
    df = spark.createDataFrame(rows, "asset string, pos int, begin timestamp_ntz, close double")
    got = column(quality.log_returns(df, max_gap_days=7), "log_return")
    assert got[:2] == [None, None] and got[2] == pytest.approx(math.log(1.1))
    gap = quality.calendar_gaps(df, 7).collect()
    assert len(gap) == 1 and gap[0].gap_days == 27
    with pytest.raises(ValueError):
        quality.calendar_gaps(df, 0.5)
    assert quality.without_unfinished(df, "2022-03-25").count() == 2


def test_moments_and_ranges(spark):
    got = volatility.rolling_moments(frame(spark, [1] * 3, r=[-1, 0, 1]), "r", 3).orderBy("pos").collect()[-1]
    assert got.m2 == pytest.approx(2 / 3) and got.m3 == pytest.approx(0) and got.skewness == pytest.approx(0)
    flat = volatility.close_to_close_volatility(frame(spark, [1] * 10, r=[0.01] * 10), "r", 5)
    assert column(flat, "close_to_close_volatility")[-1] == pytest.approx(0, abs=1e-12)
    ranged = volatility.parkinson_volatility(frame(spark, [1] * 5, high=[110] * 5, low=[100] * 5), 5, annual=1)
    assert column(ranged, "parkinson_volatility")[-1] == pytest.approx(math.log(1.1) / math.sqrt(4 * math.log(2)))
    rows = volatility.variance_proxies(frame(spark, [100, 110], high=[101, 111], low=[99, 109])).orderBy("pos").collect()
    assert rows[1].gap_rogers_satchell > rows[1].rogers_satchell and rows[0].gap_rogers_satchell is None
    with pytest.raises(ValueError):
        volatility.variance_proxies(frame(spark, [1]), center=4)


def test_future_variance_is_strictly_later(spark):
    got = column(trend.future_variance(frame(spark, [1] * 5, q=[0, 1, 4, 9, 16]), "q", 2), "future_variance")
    assert got == pytest.approx([2.5, 6.5, 12.5, None, None])


def test_suppression_keeps_the_strongest(spark):
    level = [1, 1, 5, 4, 1, 1, 6, 5, 1]
    got = events.volatility_peaks(frame(spark, [1] * 9, v=level), "v", 0.7, 1).orderBy("pos").collect()
    assert [(r.event_id, r.pos) for r in got] == [(0, 2), (1, 6)]
    study = responses.event_study(frame(spark, [1] * 20, v=[1] * 8 + [5] + [1] * 11), frame(spark, [1] * 20, v=[1] * 20).where("pos = 8").withColumn("event_id", F.lit(0)), "v", 5, 5)
    assert {r.offset: r.normalized_excess for r in study.collect()}[0] == 1.0


def test_past_sigma_uses_the_past_only(spark):
    got = column(events.return_score(frame(spark, [1] * 6, r=[1, -1, 1, -1, 1, 10]), "r", 5), "past_sigma")
    assert got[-1] == pytest.approx(np.std([1, -1, 1, -1, 1])) and got[:5] == [None] * 5


def test_smearing_does_not_compound_in_the_median_path(spark):
    for smear in (1.0, 5.0):
        df = frame(spark, [1]).select("asset", F.array_repeat(F.lit(0.01), 22).alias("h"), F.lit(math.log(0.01)).alias("har_const"), *[F.lit(0.0).alias(c) for c in ("har_daily", "har_weekly", "har_monthly")], F.lit(smear).alias("har_smearing"))
        assert df.select(har.recursive_path(F.col("h"), 3)).first()[0] == pytest.approx([0.01] * 3)


def test_innovations_never_look_ahead(spark):
    r = np.random.default_rng(7)
    q = np.exp(r.normal(-7, 0.3, 330))
    changed = q.copy()
    changed[-1] *= 50
    runs = [har.innovations(frame(spark, [1] * 330, q=v), "q", initial=150, every=30, mad_window=100).orderBy("pos").collect() for v in (q, changed)]
    assert [x.shock_score for x in runs[0][:-1]] == [x.shock_score for x in runs[1][:-1]]
    assert runs[0][-1].forecast_variance == runs[1][-1].forecast_variance and sum(x.shock_score is not None for x in runs[0]) > 100


def test_numeric_fits():
    r = np.random.default_rng(42)
    x = np.column_stack([np.ones(2500), r.standard_normal((2500, 2))])
    y = x @ [-0.4, 0.35, 0.05] + 0.12 * r.standard_normal(2500)
    fit = numeric.ols_hac(x, y, 5)
    assert fit.beta == pytest.approx([-0.4, 0.35, 0.05], abs=0.02) and np.sqrt(fit.cov[1, 1]) == pytest.approx(0.12 / 50, rel=0.3)
    y[::50] += 30
    assert numeric.huber(x, y) == pytest.approx([-0.4, 0.35, 0.05], abs=0.05)
    t = np.arange(30.0)
    p, sse = decay._fit(t, decay.curve("landau", t, np.array([0.8, 9.0, 1.4])), "landau")
    assert math.sqrt(sse / 30) < 1e-4
    assert decay.curve("landau", t, np.array([0.8, 9.0, 1e-12])) == pytest.approx(decay.curve("exponential", t, np.array([0.8, 9.0])))


def test_affine_mobility_is_recovered(spark):
    rows = [("a", y, k, 50.0 + 5 * k + y % 7, 100, 0.012 * (50.0 + 5 * k + y % 7)) for y in range(2020, 2025) for k in range(8)]
    bins = spark.createDataFrame(rows, "asset string, year int, bucket int, price double, observations long, mobility double")
    fits = {r.model: r for r in hourly.fit_mobility(bins).collect()}
    assert fits["proportional"].b == pytest.approx(0.012, abs=1e-8)
    winner = hourly.cross_validate_mobility(bins).where("winner").first()
    assert winner.model in ("proportional", "affine")
    skew = [r[0] for r in spark.range(1, 9).select(hourly.affine_skewness(0.03, F.col("id"))).collect()]
    assert skew == sorted(skew) and skew[0] >= 0


def test_standardisation_of_earlier_bars_does_not_change(spark):
    r = np.random.default_rng(7)
    rows = []
    for d in range(60):
        for h in range(10, 19):
            o = 100.0
            rows.append(["a", DAY + dt.timedelta(days=d, hours=h), o, o * 1.01, o * 0.99, o * math.exp(0.004 * r.standard_normal()), 1000.0])
    schema = "asset string, begin timestamp_ntz, open double, high double, low double, close double, volume double"
    runs = []
    for factor in (1.0, 1.5):
        rows[-1][5] *= factor
        z = hourly.standardised(quality.prepared_hourly(spark.createDataFrame(rows, schema)), 30, 10, strict_past=True)
        runs.append(column(z, "conditional_scale"))
    assert runs[0][:-1] == runs[1][:-1] and runs[0][-1] == runs[1][-1]


def test_payloads_routes_and_zips(spark, tmp_path):
    got = candles.payload_rows(spark, {"t": {"columns": ["A", "b"], "data": [[1, None]]}}, "t").collect()
    assert got[0].a == "1" and got[0].b is None
    with pytest.raises(candles.PayloadError):
        candles.payload_rows(spark, {}, "t")
    boards = spark.createDataFrame([("X", "B1", "e", "m", 0, 0), ("X", "B2", "e", "m", 1, 1), ("X", "B3", None, "m", 1, 2)], "secid string, boardid string, engine string, market string, is_primary int, turn int")
    assert candles.resolve_route(boards).first().boardid == "B2" and candles.resolve_route(boards, "b1").first().boardid == "B1"
    assert candles.resolve_route(boards, "zz").count() == 0
    body = "begin,open,high,low,close,volume\n2024-01-01 10:00:00,1,2,1,2,5\n2024-01-01 10:00:00,9,9,9,9,9\nbad,1,1,1,x,1\n"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/candles/gold.csv", body)
        z.writestr("x/candles/broken.csv", "a,b\n1,2\n")
        z.writestr("readme.txt", "no")
    rows = candles.read_candle_zips(spark, f"file://{tmp_path}/z.zip").orderBy(F.col("begin").asc_nulls_last()).collect()
    assert [(r.asset, r.open) for r in rows] == [("GOLD", 1.0), ("GOLD", 1.0)] and rows[1].begin is None and rows[1].close is None
    with pytest.raises(ValueError, match="close"):
        require_columns(boards, {"close"})


def test_flat_aftershocks_are_no_decay(spark):
    r = np.random.default_rng(12)
    rows = [("a", k, int(n), 100, 0.1) for k, n in enumerate(r.binomial(100, 0.1, 30), 1)]
    got = decay.fit_omori(spark.createDataFrame(rows, "asset string, offset int, count long, exposed_events long, baseline_rate double")).first()
    assert not got.meaningful_decay
