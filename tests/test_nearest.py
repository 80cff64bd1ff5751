"""Nearest rows in time against brute force, multiplicities against draws, exponential windows against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shockwell.functions.columns import median, quantile
from shockwell.operators.nearest import nearest_in_time
from shockwell.operators.responses import bootstrap_interval, resampled, weighted_mean, weighted_median
from shockwell.operators.volatility import EWMA_BLOCK, ewma_volatility

EVENTS, POOL = "g string, event_id int, t int, x double", "g string, c int, y double"


def brute(events, pool, k, rate, reach):
    out = set()
    for g, i, t, x in events:
        near = sorted((abs(x - y) + rate * abs(t - c), c) for h, c, y in pool if h == g)
        if reach is not None and sum(abs(t - c) <= reach for _, c in near) >= k:
            near = [(d, c) for d, c in near if abs(t - c) <= reach]
        out |= {(g, i, rank, c) for rank, (_, c) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("reach", [None, 40])
@pytest.mark.parametrize("rate", [0.001, 0.02, 1.0])
def test_nearest_is_brute_force(spark, reach, rate):
    rng = np.random.default_rng(5)
    pool = [("a", int(c), float(rng.integers(0, 40) / 8)) for c in np.flatnonzero(rng.random(3000) < 0.1)]  # ties in y
    pool += [("b", c, 0.5) for c in (7, 400, 2000)]  # fewer than k, all alike
    events = [("a", i, int(t), float(rng.integers(0, 40) / 8)) for i, t in enumerate(rng.integers(-500, 4000, 40))]
    events += [("b", 0, 100, 0.5), ("b", 1, 3000, 90.0), ("c", 0, 10, 1.0), ("a", 99, 1500, 1e9)]
    left, right = spark.createDataFrame(events, EVENTS), spark.createDataFrame(pool, POOL)
    apart = F.abs(F.col("x") - F.col("y")) + rate * F.abs(F.col("t") - F.col("c"))
    found = nearest_in_time(left, right, ["g"], "event_id", "t", "c", apart, rate, 5, "c", reach=reach, width=64.0)
    assert {(r["g"], r["event_id"], r["rank"], r["c"]) for r in found.collect()} == brute(events, pool, 5, rate, reach)


def test_nearest_in_empty_tables(spark):
    left, right = spark.createDataFrame([("a", 1, 1, 1.0)], EVENTS), spark.createDataFrame([("a", 1, 1.0)], POOL)
    apart = F.abs(F.col("x") - F.col("y")) + F.abs(F.col("t") - F.col("c"))
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert nearest_in_time(a, b, ["g"], "event_id", "t", "c", apart, 1.0, 3, "c").count() == 0


@pytest.mark.parametrize("weighted,plain", [(weighted_median, median), (weighted_mean, F.avg)])
def test_multiplicities_are_draws(spark, weighted, plain):
    rng = np.random.default_rng(2)
    data = [("a", i, k, None if i == 3 and k == 2 else float(rng.normal())) for i in range(11) for k in range(1, 4) if (i + k) % 7]
    rows = spark.createDataFrame(data, "asset string, event_id int, offset int, v double")
    drawn = resampled(rows, ["asset"], 120, 9).join(rows, ["asset", "event_id"]).groupBy("asset", "offset", "sample").agg(plain("v").alias("s"))
    want = {r["offset"]: (r["l"], r["h"]) for r in drawn.groupBy("asset", "offset").agg(quantile("s", 0.025).alias("l"), quantile("s", 0.975).alias("h")).collect()}
    own = bootstrap_interval(rows, "v", ["asset"], ["offset"], weighted, 120, 9).collect()
    assert len(own) == 3
    for r in own:
        assert (r["bootstrap_ci_low"], r["bootstrap_ci_high"]) == pytest.approx(want[r["offset"]], abs=1e-12)


def test_exponential_windows_across_blocks(spark):
    rng = np.random.default_rng(4)
    n = 3 * EWMA_BLOCK + 17
    x = pd.Series(rng.normal(5, 1, n))
    x[:4], x[EWMA_BLOCK - 2 : EWMA_BLOCK + 3] = np.nan, np.nan
    x[EWMA_BLOCK * 2 - 300 : EWMA_BLOCK * 2 + 20] = np.nan  # longer than a block
    late = pd.Series([np.nan] * (EWMA_BLOCK + 5) + rng.normal(0, 1, 40).tolist())  # nothing in the first block
    data = [(a, k, None if np.isnan(v) else float(v)) for a, s in (("a", x), ("late", late)) for k, v in enumerate(s)]
    data += [("none", k, None) for k in range(3)]
    found = ewma_volatility(spark.createDataFrame(data, "asset string, pos int, r double"), "r", 20, annual=1.0).collect()
    assert len(found) == len(data)
    for asset, s in (("a", x), ("late", late), ("none", pd.Series([np.nan] * 3))):
        want = np.sqrt(s.ewm(span=20, adjust=False, min_periods=20).var(bias=True))
        own = [r["ewma_volatility"] for r in sorted((r for r in found if r["asset"] == asset), key=lambda r: r["pos"])]
        np.testing.assert_allclose(np.array(own, float), want.to_numpy(), rtol=1e-9, atol=1e-9)  # after a long gap variances are near 0
