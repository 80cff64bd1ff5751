"""Additive Newey-West regressions against the textbook formula on each group's rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockwell.functions.numeric import normal_p, ols_hac
from shockwell.functions.regression import newey_west, share_explained


def sample(spark, groups=("a", "b"), n=150):
    draw = np.random.default_rng(8)
    rows = []
    for g in groups:
        x = draw.normal(size=(n, 2)).cumsum(axis=0) / 5
        noise = np.convolve(draw.normal(size=n + 3), [1, 0.7, 0.4, 0.2], "valid")
        y = 1.5 + x @ np.array([0.8, -0.3]) + noise
        rows += [(g, k * 3, 2000 + k // 40, float(a), float(b), float(v)) for k, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    draw.shuffle(rows)
    return rows, spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in rows], "g string, at int, year int, x1 double, x2 double, y double").withColumn("one", F.lit(1.0))


@pytest.mark.parametrize("lags", [0, 1, 5, 34, 200])
@pytest.mark.parametrize("effects", [None, [], ["year"]])
def test_estimates_and_errors(spark, lags, effects):
    rows, df = sample(spark)
    names = ["x1", "x2"] if effects is not None else ["one", "x1", "x2"]
    contrasts = {"first": [0.0] * (len(names) - 2) + [1.0, 0.0], "difference": [0.0] * (len(names) - 2) + [1.0, -1.0]}
    # lags as a column of the group too: one group takes a lag more
    lag = F.when(F.col("g") == "b", lags + 1).otherwise(lags)
    found = {(r["g"], r["term"]): r for r in newey_west(df, ["g"], "at", "y", names, lag, contrasts, effects).collect()}
    assert len(found) == 4
    for g in ("a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        x = np.array([[1.0, r[3], r[4]] for r in own])
        if effects == ["year"]:
            x = np.column_stack([x, *[[float(r[2] == year) for r in own] for year in sorted({r[2] for r in own})[1:]]])
        fit = ols_hac(x, np.array([r[5] for r in own]), lags + (g == "b"))
        for term, w in (("first", [0, 1, 0]), ("difference", [0, 1, -1])):
            w = np.array(w + [0] * (x.shape[1] - 3), float)
            r, b, se = found[g, term], w @ fit.beta, math.sqrt(w @ fit.cov @ w)
            assert (r["estimate"], r["std_error"], r["r_squared"]) == pytest.approx((b, se, fit.r_squared), rel=1e-8)
            assert r["n"] == 150 and r["p_value"] == pytest.approx(normal_p(b / se), rel=1e-6, abs=1e-12) and r["ci_high"] - r["ci_low"] == pytest.approx(2 * 1.959963984540054 * se)


def test_share_explained(spark):
    rows, df = sample(spark)
    found = {r["g"]: r["r_squared"] for r in share_explained(df, ["g"], "y", ["x1", "x2"]).collect()}
    for g in ("a", "b"):
        own = [r for r in rows if r[0] == g]
        assert found[g] == pytest.approx(ols_hac(np.array([[1.0, r[3], r[4]] for r in own]), np.array([r[5] for r in own]), 0).r_squared)


def test_small_and_singular_groups(spark):
    df = spark.createDataFrame([("one", 1, 2.0, 4.0, 3.0), ("flat", 1, 1.0, 2.0, 5.0), ("flat", 2, 2.0, 4.0, 5.0), ("flat", 3, 3.0, 6.0, 5.0)], "g string, at int, x1 double, x2 double, y double")
    found = {(r["g"], r["term"]): r for r in newey_west(df, ["g"], "at", "y", ["x1", "x2"], 2, absorb=[]).collect()}
    assert len(found) == 4 and found["flat", "x1"]["estimate"] == pytest.approx(0) and found["flat", "x1"]["r_squared"] is None
    assert newey_west(df.limit(0), ["g"], "at", "y", ["x1"], 2, absorb=[]).count() == 0
    with pytest.raises(ValueError):
        newey_west(df, ["g"], "at", "y", ["x1"], -1)
