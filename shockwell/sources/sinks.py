"""Exports of candle panels: a folder for each asset, rewritten asset by asset, read back with pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockwell.operators.quality import log_returns
from shockwell.operators.volatility import variance_proxies

FORMATS = ("csv", "parquet")
#: Rows of one asset in a file.
FILE_ROWS = 5_000_000


def write_panel(df: DataFrame, path: str, form: str = "csv", by: str = "asset", file_rows: int = FILE_ROWS) -> None:
    """`df` in a folder for each value of `by`; those that `df` doesn't hold keep what they have.

    Rows of one value meet in as few tasks as its size asks for: those of up to `file_rows` are one file, larger ones are
    dealt to several. Doubles are written with all their digits, times in UTC to the microsecond; nulls are empty.
    """
    if form not in FORMATS:
        raise ValueError(f"form must be one of {FORMATS}")
    counts = df.groupBy(by).agg(F.ceil(F.count("*") / file_rows).alias("_files"))
    dealt = df.join(F.broadcast(counts) if counts.count() <= 100_000 else counts, df[by].eqNullSafe(counts[by])).drop(counts[by])
    part = F.when(F.col("_files") > 1, F.pmod(F.xxhash64(*[c for c in df.columns if c != by]), F.col("_files"))).otherwise(0)
    rows = dealt.withColumn("_part", part).repartition(by, "_part").drop("_files", "_part")
    sort = [c for c in (by, "pos", "begin") if c in df.columns]
    writer = rows.sortWithinPartitions(*sort).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if form == "csv":
        writer = writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    writer.format(form).save(path)


def read_panel(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "csv", assets: list[str] | None = None) -> DataFrame:
    """What `write_panel` wrote, with the columns of `schema`; with `assets`, only their folders are listed and read."""
    if form not in FORMATS:
        raise ValueError(f"form must be one of {FORMATS}")
    reader = spark.read.schema(schema).format(form)
    if form == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = reader.load(path)
    return rows if assets is None else rows.where(F.col("asset").isin(assets))


def daily_export(candles: DataFrame, max_gap_days: float | None = None) -> DataFrame:
    """What a daily export holds: candles, the variance proxies and the return with and without gaps."""
    rows = variance_proxies(candles, max_gap_days=max_gap_days) if max_gap_days is not None else variance_proxies(candles)
    raw = log_returns(candles).select("asset", "pos", F.col("log_return").alias("raw_log_return"))
    clean = (log_returns(candles, max_gap_days=max_gap_days) if max_gap_days is not None else log_returns(candles)).select("asset", "pos", F.col("log_return").alias("cleaned_log_return"))
    return rows.join(raw, ["asset", "pos"]).join(clean, ["asset", "pos"])
