"""Column helpers: guarded arithmetic and windows over one asset's rows in the order of their position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The floor of logarithms of variances, trading days in a year, MAD to standard deviation (two forms in use).
EPSILON, ANNUAL, MAD_SCALE, MAD_QUANTILE = 1e-12, 252.0, 1.4826, 0.67448975


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ln_positive(x: Column | str) -> Column:
    """ln(x) where x is positive, else null."""
    return F.when(col(x) > 0, F.ln(x))


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """x between the bounds; null stays null (greatest and least would skip it)."""
    y = col(x)
    if high is not None:
        y = F.least(y, F.lit(high))
    if low is not None:
        y = F.greatest(y, F.lit(low))
    return F.when(col(x).isNotNull(), y)


def series(*by: str):
    return Window.partitionBy(*(by or ("asset",))).orderBy("pos")


def rolling(fn: Callable[[Column], Column], x: Column | str, low: int, high: int, least: int | None = None, window=None) -> Column:
    """fn(x) over the rows from `low` to `high` around each row, null with fewer than `least` values (default: all)."""
    frame = (window or series()).rowsBetween(low, high)
    need = high - low + 1 if least is None else least
    return F.when(F.count(x).over(frame) >= need, fn(col(x)).over(frame))


def trailing(fn: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None) -> Column:
    return rolling(fn, x, -(n - 1), 0, least)


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def quantile(x: Column | str, q: float) -> Column:
    return F.percentile(x, F.lit(q))


def average_rank(x: Column | str, *by: str) -> Column:
    """Rank from 1 among a group's rows; ties share the mean of their ranks. Rows must not be null."""
    ranks, ties = Window.partitionBy(*by).orderBy(x), Window.partitionBy(*by, x)
    return F.rank().over(ranks) + (F.count("*").over(ties) - 1) / 2.0


def quantile_bucket(x: Column | str, groups: int, *by: str) -> Column:
    """Number from 1 of the quantile interval (closed on the right, lowest value included); equal edges merge."""
    edges = F.array_distinct(F.percentile(x, F.array(*[F.lit(k / groups) for k in range(groups + 1)])).over(Window.partitionBy(*by)))
    return F.greatest(F.size(F.filter(edges, lambda e: e < col(x))), F.lit(1))


def with_robust_scale(df: DataFrame, x: str, out: str, by: list[str], factor: float = MAD_SCALE, spread: bool = True) -> DataFrame:
    """`df` with (x - median) / (factor * MAD) in `out`, by group; MAD 0: the standard deviation (if `spread`), that 0: 1."""
    group = Window.partitionBy(*by)
    df = df.withColumn("_mid", median(x).over(group)).withColumn("_dev", F.col(x) - F.col("_mid"))
    mad = factor * median(F.abs("_dev")).over(group)
    rest = F.stddev_pop(x).over(group) if spread else F.lit(1.0)
    df = df.withColumn("_mad", mad).withColumn("_std", rest)
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return df.withColumn(out, F.col("_dev") / scale).drop("_mid", "_dev", "_mad", "_std")


def require_columns(df: DataFrame, names: set[str]) -> None:
    """ValueError with the sorted names that `df` lacks; looks at the schema only."""
    if missing := sorted(names - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")


def hash_draw(seed: int, *parts: Column | str) -> Column:
    """A pseudo-random long from 0 to 2**32 - 1 that depends on nothing but its arguments, alike in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
