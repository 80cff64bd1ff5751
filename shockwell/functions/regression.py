"""Least squares with Newey-West errors for many groups at once, from sums that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockwell.functions.numeric import normal_p
from shockwell.functions.storage import written

#: Fixed value: half the width of a 95 % interval in standard errors.
Z95 = 1.959963984540054
#: A window of L + 1 rows is a range of SCALE - MOST_LAGS - 2 over steps of SCALE // (L + 1), so that one frame serves every L.
SCALE, MOST_LAGS = 1 << 20, 500
RESULT = "n long, r_squared double, term string, estimate double, std_error double, z_value double, p_value double, ci_low double, ci_high double"


def _square(values: pd.Series, k: int) -> np.ndarray:
    """A symmetric matrix from its upper half."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = values
    return out + np.triu(out, 1).T


def _upper(columns: list[Column]) -> Column:
    """Sums of the products of each pair of columns, as an array in the order of an upper half."""
    return F.array(*[F.sum(a * b) for k, a in enumerate(columns) for b in columns[k:]])


def _solved(k: int, schema: T.StructType):
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inverse, beta = [], []
            for upper in batch["products"]:
                whole = _square(np.asarray(upper, float), k + 1)
                own = np.linalg.pinv(whole[:k, :k], hermitian=True)
                inverse.append(own.ravel().tolist())
                beta.append((own @ whole[:k, k]).tolist())
            yield batch.assign(inverse=inverse, beta=beta)[names]

    return run


def _told(k: int, contrasts: dict[str, list[float]], schema: T.StructType):
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                inverse, beta = np.asarray(r["inverse"], float).reshape(k, k), np.asarray(r["beta"], float)
                cov = inverse @ _square(np.asarray(r["meat"], float), k) @ inverse / (r["_lags"] + 1) * r["n"] / max(r["n"] - r["fitted"], 1)
                r["r_squared"] = 1 - r["sse"] / r["total"] if r["total"] > 0 else float("nan")
                for term, weights in contrasts.items():
                    w = np.asarray(weights, float)
                    b, se = float(w @ beta), float(np.sqrt(w @ cov @ w))
                    z = b / se if se > 0 else float("nan")
                    rows.append({**r, "term": term, "estimate": b, "std_error": se, "z_value": z, "p_value": normal_p(z), "ci_low": b - Z95 * se, "ci_high": b + Z95 * se})
            yield pd.DataFrame(rows, columns=names)

    return run


def newey_west(rows: DataFrame, by: list[str], order: str, y: str, x: list[str], lags: int | Column, contrasts: dict[str, list[float]] | None = None, absorb: list[str] | None = None) -> DataFrame:
    """(by, RESULT): for each group the least squares of y on the columns x, in the order of `order`, with a Newey-West
    covariance of `lags` (a number, or a column that is the same throughout a group), Bartlett weights and the factor
    n / (n - k). A row for each of the `contrasts` (name to weights of x); without them, for each of x.

    `absorb` names columns whose groups have an effect of their own (none named: one constant): x and y are centred inside
    them, which gives the same estimates and errors as a dummy for each. Without it nothing is centred: put a constant in x.

    Bartlett's weights are those of sums over all windows of `lags` + 1 neighbours, so the middle of the covariance is one
    moving sum of scores and its products. Everything is a window or a sum of products over a group's rows; Python sees one
    row for each group, to solve k by k systems (of least norm where they are singular). Rows with nulls must be left out.
    `rows` is read twice, before and after the systems are solved: give it a written table if it is dear to make.
    """
    if isinstance(lags, int) and not 0 <= lags <= MOST_LAGS:
        raise ValueError(f"lags must be 0 to {MOST_LAGS}")
    k = len(x)
    contrasts = contrasts or {n: [float(i == j) for j in range(k)] for i, n in enumerate(x)}
    keys = [F.col(c) for c in by]
    lag = F.lit(lags) if isinstance(lags, int) else lags
    own = [f"_x{j}" for j in range(k)]
    work = rows.select(*by, F.col(order).alias("_order"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(n) for c, n in zip(x, own, strict=True)], F.least(lag, F.lit(MOST_LAGS)).cast("int").alias("_lags"), *[F.col(c).alias(f"_a{j}") for j, c in enumerate(absorb or [])])
    effects = [f"_a{j}" for j in range(len(absorb or []))]
    raw = F.var_pop("_y").over(Window.partitionBy(*by))
    work = work.withColumn("_var", raw)
    if absorb is not None:
        inside = Window.partitionBy(*by, *effects)
        work = work.withColumns({c: F.col(c) - F.avg(c).over(inside) for c in ("_y", *own)})
    counted = F.count_distinct(F.struct(*effects)) if effects else F.lit(1 if absorb is not None else 0)
    sums = work.groupBy(*by).agg(F.count("*").alias("n"), F.max("_lags").alias("_lags"), (F.lit(k) + counted).cast("int").alias("fitted"), (F.max("_var") * F.count("*")).alias("total"), _upper([*[F.col(c) for c in own], F.col("_y")]).alias("products"))
    head = [rows.schema[c] for c in by]
    numbers = T._parse_datatype_string("n long, _lags int, fitted int, total double, inverse array<double>, beta array<double>").fields
    solved = written(sums.mapInPandas(_solved(k, T.StructType([*head, *numbers])), T.StructType([*head, *numbers])), "solved")  # a row for each group
    left = work.drop("_lags", "_var", *effects).join(solved.select(*by, "beta", "_lags", "n"), by)
    left = left.withColumn("_u", F.col("_y") - sum((F.get("beta", F.lit(j)) * F.col(c) for j, c in enumerate(own)), F.lit(0.0)))
    left = left.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy("_order")).cast("long"))
    scores = left.select(*keys, "_row", "_lags", "_u", *[(F.col(c) * F.col("_u")).alias(c) for c in own])
    after = solved.where("_lags > 0").select(*by, F.explode(F.sequence(F.col("n") + 1, F.col("n") + F.col("_lags"))).alias("_row"), "_lags", F.lit(0.0).alias("_u"), *[F.lit(0.0).alias(c) for c in own])
    frame = Window.partitionBy(*by).orderBy("_at").rangeBetween(-(SCALE - MOST_LAGS - 2), 0)
    moved = scores.unionByName(after).withColumn("_at", F.col("_row") * F.floor(F.lit(SCALE) / (F.col("_lags") + 1)).cast("long"))
    moved = moved.select(*by, "_u", *[F.sum(c).over(frame).alias(c) for c in own])
    meat = moved.groupBy(*by).agg(F.sum(F.col("_u") * F.col("_u")).alias("sse"), _upper([F.col(c) for c in own]).alias("meat"))
    result = T.StructType([*head, *T._parse_datatype_string(RESULT).fields])
    return solved.join(meat, by).mapInPandas(_told(k, contrasts, result), result)


def share_explained(rows: DataFrame, by: list[str], y: str, x: list[str]) -> DataFrame:
    """(by, r_squared) of the least squares of y on x and a constant."""
    k, inside = len(x), Window.partitionBy(*by)
    centred = rows.select(*by, *[(F.col(c) - F.avg(c).over(inside)).alias(f"_c{j}") for j, c in enumerate([*x, y])])
    sums = centred.groupBy(*by).agg(_upper([F.col(f"_c{j}") for j in range(k + 1)]).alias("products"))
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("products", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType())), T.StructField("beta", T.ArrayType(T.DoubleType()))])
    solved = sums.mapInPandas(_solved(k, schema), schema)
    # in an upper half of k + 1 columns the last of row j stands at (j + 1) (k + 1) - j (j + 1) / 2 - 1
    last = [(j + 1) * (k + 1) - j * (j + 1) // 2 - 1 for j in range(k + 1)]
    told = sum((F.get("beta", F.lit(j)) * F.get("products", F.lit(last[j])) for j in range(k)), F.lit(0.0))
    return solved.select(*by, F.when(F.get("products", F.lit(last[k])) > 0, told / F.get("products", F.lit(last[k]))).alias("r_squared"))
