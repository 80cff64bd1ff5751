"""Cases in which an operator's rule shows: bars without variance, gaps in offsets, planted laws."""

import math
import random

import numpy as np
import pytest

from shockwell.operators import decay, har, hourly, panels, responses

DIAGNOSTICS = "asset string, pos int, begin timestamp, q double"


def bars(spark, values):
    import datetime

    start = datetime.datetime(2020, 1, 1)
    return spark.createDataFrame([("A", k, start + datetime.timedelta(days=k), v) for k, v in enumerate(values)], DIAGNOSTICS)


FIXED = {"har_const": -0.5, "har_daily": 0.2, "har_weekly": 0.3, "har_monthly": 0.4, "har_smearing": 1.3}


def test_a_bar_without_variance_counts_as_missing(spark):
    r = random.Random(1)
    values = [math.exp(r.gauss(-9, 0.5)) for _ in range(180)]
    values[150], values[160] = 0.0, None
    got = {x.pos: x for x in har.innovations(bars(spark, values), "q", initial=120, every=20, coefficients=FIXED).collect()}
    assert got[150].variance_proxy is None and got[150].innovation is None and got[160].innovation is None
    for pos in (151, 165):
        past = [v for v in values[:pos] if v]
        state = [past[-1], np.mean(past[-5:]), np.mean(past[-22:])]
        want = math.exp(-0.5 + 0.2 * math.log(state[0] + 1e-12) + 0.3 * math.log(state[1] + 1e-12) + 0.4 * math.log(state[2] + 1e-12)) * 1.3
        assert got[pos].forecast_variance == pytest.approx(want, rel=1e-9)


def test_a_failed_fit_is_tried_again_at_the_next_bar(spark):
    r = random.Random(2)
    values = [math.exp(r.gauss(-9, 0.5)) if k >= 10 else None for k in range(170)]
    fits = har.fit_coefficients(bars(spark, values), "q", initial=120, every=20).collect()
    # 22 bars of state and 120 of fitting are needed: the first 10 are missing
    assert [(x.block, x.fit_pos) for x in sorted(fits, key=lambda x: x.block)] == [(1, 152), (2, 160)]
    got = {x.pos: x.har_const for x in har.innovations(bars(spark, values), "q", initial=120, every=20).collect()}
    assert got[151] is None and got[152] is not None and got[160] is not None


def test_windows_with_a_bar_without_variance_are_left_out(spark):
    values = [0.5 + 0.01 * (k % 7) for k in range(60)]
    values[40] = 0.0
    rows = har.with_history(bars(spark, values), "q").selectExpr("*", "case when q > 0 then q end as variance_proxy", "1.0 as shock_score")
    rows = rows.selectExpr("*", *[f"cast({v} as double) as {k}" for k, v in FIXED.items()])
    events = rows.where("pos in (25, 48)").selectExpr("*", "cast(pos as int) as event_id", "'negative' as direction")
    kept = lambda post: {x.event_id for x in responses.counterfactual_paths(rows, events, window=3, post=post).collect()}
    assert kept(5) == {25, 48} and kept(13) == set() and kept(12) == set() | ({25} if 25 + 12 + 2 < 40 else set())


def test_mean_paths_take_bars_as_they_are(spark):
    """A missing or zero bar among the 22 before an event leaves it out; one in a window after it only if it is missing."""
    values = [0.5 + 0.01 * (k % 7) for k in range(80)]
    values[10], values[40], values[70] = None, 0.0, None
    rows = har.with_history(bars(spark, values), "q").selectExpr("*", "case when q > 0 then q end as variance_proxy", "1.0 as shock_score")
    rows = rows.selectExpr("*", *[f"cast({v} as double) as {k}" for k, v in FIXED.items()])
    events = rows.where("pos in (30, 34, 45, 63)").selectExpr("*", "cast(pos as int) as event_id", "'negative' as direction")
    found = lambda post, **how: {x.event_id for x in responses.counterfactual_paths(rows, events, window=3, post=post, **how).collect()}
    # 30: bar 10 is missing; 45: bar 40 is zero; 63: the window of bars 68 to 70 holds a missing bar
    assert found(4, smearing=True, variance="q") == {34, 63} and found(5, smearing=True, variance="q") == {34}
    paths = {x.offset: x for x in responses.counterfactual_paths(rows, events.where("pos = 34"), window=3, post=6, smearing=True, variance="q").collect()}
    assert paths[6].actual_variance == pytest.approx((0.0 + values[41] + values[42]) / 3)
    # the median path skips such bars in its history, and leaves out windows that hold one
    assert found(2) == {30, 34, 45, 63} and found(6) == {30, 45}
    state = np.array([values[33], np.mean(values[29:34]), np.mean(values[12:34])])
    path = []
    for _ in range(9):
        path.append(math.exp(-0.5 + np.log(state_of(values[12:34], path) + 1e-12) @ np.array([0.2, 0.3, 0.4])) * 1.3)
    assert state_of(values[12:34], [])[0] == state[0]
    assert paths[1].counterfactual_variance == pytest.approx(np.mean(path[1:4]), rel=1e-12)


def state_of(history, path):
    own = [*history, *path]
    return np.array([own[-1], np.mean(own[-5:]), np.mean(own[-22:])])


def test_gates_count_rows_not_offsets(spark):
    rows = [("A", "negative", o, m, 0.1, 30) for o, m in zip(range(1, 40, 3), [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, -0.1, -0.1, -0.1, 0.2, 0.2, 0.2, 0.2], strict=True)]
    table = spark.createDataFrame(rows, "asset string, direction string, offset int, median double, bootstrap_ci_low double, count int")
    got = decay.fit_gate(table).first()
    assert (got.fit_start, got.fit_end, got.allowed) == (1, 16, True)  # six rows, up to the one before the run


def planted(spark, law, parameters, events=40, seed=4):
    r = random.Random(seed)
    rows = []
    for e in range(events):
        x = r.uniform(0.3, 3.0)
        t = np.arange(1, 22)
        y = decay.amplitude_curve(law, t, np.full(21, x), np.array(parameters))
        rows += [("internal-like", "negative", f"e{e}", o, x) for o in (1, 2, 3)]
        rows += [("internal-like", "negative", f"e{e}", int(k) + 3, float(v) + r.gauss(0, 0.01)) for k, v in zip(t, y, strict=True)]
    return spark.createDataFrame(rows, "process_class string, direction string, event_id string, offset int, abnormal_m2 double")


def test_amplitude_laws_start_after_the_initial_hours(spark):
    sample = decay.amplitude_sample(planted(spark, "landau", (9.0, 0.8)))
    assert {(x.offset, x.t) for x in sample.select("offset", "t").distinct().collect()} == {(k + 3, k) for k in range(1, 22)}
    fits = {x.model: x for x in decay.amplitude_summary(sample, decay.amplitude_fits(sample)).collect()}
    assert fits["landau"].parameters["tau"] == pytest.approx(9.0, rel=0.05) and fits["landau"].parameters["theta"] == pytest.approx(0.8, rel=0.1)
    assert min(fits.values(), key=lambda x: x.rmse).model == "landau" and fits["landau"].sample_size == 40 * 21
    checked = {x.model: x for x in decay.amplitude_validation(sample).collect()}
    assert [m for m, x in checked.items() if x.winner] == ["landau"] and checked["landau"].events == 40 and checked["landau"].burden_mae_12 < 0.2
    few = decay.amplitude_sample(planted(spark, "exponential", (5.0,), events=5))
    assert decay.amplitude_fits(few).count() == 0


@pytest.mark.parametrize("law", list(decay.PROCESS_LAWS))
def test_process_laws_find_themselves(spark, law):
    given = {"floor": 0.1, "amplitude": 0.8, "tau": 9.0, "q": 0.4, "amplitude_fast": 0.6, "tau_fast": 1.0, "amplitude_slow": 0.4, "tau_slow": 30.0, "exponent": 1.4}
    times = spark.range(1, 25).selectExpr("'x' as g", "cast(id as int) as offset", "cast(id as double) as t")
    fits = spark.createDataFrame([("x", law, {k: given[k] for k in decay.PROCESS_LAWS[law]})], "g string, model string, parameters map<string,double>")
    curve = decay.predict_process(times, fits, ["g"]).withColumnRenamed("predicted", "y").drop("model", "parameters")
    got = {x.model: x for x in decay.fit_process_models(curve, ["g"], "y").collect()}
    assert set(got) == set(decay.PROCESS_LAWS) and got[law].rmse < 0.004


def test_non_negative_least_squares_is_the_best_of_a_grid():
    draw = np.random.default_rng(3)
    for _ in range(20):
        y, x = draw.normal(0.3, 1, 12), draw.random((1, 12))
        beta, sse = decay._floored(y, x)
        grid = min((float(((y - a - b * x[0]) ** 2).sum()) for a in np.linspace(0, 3, 61) for b in np.linspace(0, 5, 101)), default=0)
        assert (beta >= 0).all() and sse[0] <= grid + 1e-9


def test_omori_rate(spark):
    rows = [("A", k, 0.4 / (k + 1.5) ** 0.9) for k in range(1, 31)]
    got = decay.fit_omori_rate(spark.createDataFrame(rows, "asset string, offset int, rate double")).first()
    assert (got.scale, got.shift, got.exponent) == pytest.approx((0.4, 1.5, 0.9), rel=1e-3) and (got.fit_start, got.fit_end, got.sample_size) == (1, 30, 30)


def test_horizons_stay_in_a_day(spark):
    import datetime

    r = random.Random(6)
    rows, price = [], 100.0
    for day in range(40):
        for hour in range(10, 19):
            if hour == 13 and day % 2:
                continue  # a missing hour: increments over it don't count
            new = price * math.exp(r.gauss(0, 0.01))
            rows.append(("A", datetime.datetime(2021, 1, 1) + datetime.timedelta(days=day, hours=hour), price, new, price, True))
            price = new
    table = spark.createDataFrame(rows, "asset string, begin timestamp, open double, close double, price double, regular_session boolean")
    law = spark.createDataFrame([("A", "affine", 0.1, 0.01)], "asset string, model string, a double, b double")
    got = {x.horizon_hours: x for x in hourly.affine_horizon_test(table, law, (1, 2)).collect()}
    assert got[1].observations == 40 * 9 - 20 and got[2].observations == 20 * 8 + 20 * 6
    assert got[2].predicted_affine_skewness == pytest.approx((math.exp(2e-4) + 2) * math.sqrt(math.exp(2e-4) - 1))


def test_labels_and_records(spark):
    rows = [(" ab ", "Name", "B1"), ("cd", "nan", None), ("ef", "", "")]
    table = spark.createDataFrame(rows, "secid string, shortname string, board string")
    got = [x.l for x in table.select(panels.instrument_label("secid", "shortname", "board").alias("l")).collect()]
    assert got == ["Name — AB · B1", "CD — CD", "EF — EF"]
