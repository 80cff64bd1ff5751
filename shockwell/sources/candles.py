"""Candles: a panel with one row per asset and bar, from ticks, files or an exchange's JSON."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.functions.columns import require_columns

CANDLE = "asset string, begin timestamp_ntz, open double, high double, low double, close double, volume double, value double"
#: Names under which a contract is listed instead, and the exchange's interval codes.
ALIASES = {"USDRUB_TOM": "USD000UTSTOM"}
INTERVALS = (1, 10, 60, 24, 7, 31, 4)


def positioned(df: DataFrame) -> DataFrame:
    """`df` with pos, the number of each row in its asset's order of begin, from 0."""
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy("asset").orderBy("begin")) - 1).cast("int"))


def ticks_to_candles(ticks: DataFrame, order: list[str]) -> DataFrame:
    """Candles from ticks (asset, begin, price, quantity); `order` makes ticks of a bar unique and first to last."""
    turn = F.struct(*order)
    bars = ticks.groupBy("asset", "begin").agg(
        F.min_by("price", turn).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", turn).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("price").alias("value"),
    )
    return positioned(bars)


def daily_candles(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    """Daily candles of lineitem, an asset for each return flag (or one for all)."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_extendedprice > 0")
    asset = F.lit("ALL") if pooled else F.col("l_returnflag")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    ticks = t.select(asset.alias("asset"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("begin"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), *order)
    return ticks_to_candles(ticks, order)


def sparse_daily_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of orders, an asset for each priority; days without orders are missing."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 0")
    ticks = t.select(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("begin"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("quantity"), "o_orderkey")
    return ticks_to_candles(ticks, ["o_orderkey"])


def hourly_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of events with a positive value, an asset for each type."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    ticks = t.select(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("begin"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"), "ts", "event_id")
    return ticks_to_candles(ticks, ["ts", "event_id"])


def normalized_symbol(symbol: Column | str) -> Column:
    """Trimmed, upper-cased, and replaced by the name it is listed under."""
    name = F.upper(F.trim(symbol))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(known, name), name)


class PayloadError(ValueError):
    """A JSON payload lacks a table or has it in another form."""


def payload_rows(spark: SparkSession, payload: dict | str, table: str) -> DataFrame:
    """The rows of a {table: {columns: [...], data: [[...]]}} payload, all as strings, in columns with lower-case names."""
    body = json.loads(payload) if isinstance(payload, str) else payload
    block = body.get(table) if isinstance(body, dict) else None
    if not isinstance(block, dict) or not isinstance(block.get("columns", []), list) or not isinstance(block.get("data", []), list):
        raise PayloadError(f"no table {table!r} of columns and data in the payload")
    names = [str(c).lower() for c in block.get("columns", [])]
    if not names:
        return spark.createDataFrame([], "none string")
    rows = [[None if v is None else str(v) for v in row] for row in block.get("data", [])]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))


def search_securities(listed: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Securities whose name or code contains the text, traded ones first; a blank query finds none."""
    text = query.strip().lower()
    hit = F.lit(False) if not text else F.lower("secid").contains(text) | F.lower("shortname").contains(text)
    return listed.where(F.coalesce(hit, F.lit(False))).orderBy(F.desc_nulls_last("is_traded"), "secid").limit(limit)


def resolve_route(boards: DataFrame, preferred: str | None = None) -> DataFrame:
    """One board for each secid: the preferred one if named, else the primary one, else the first in `turn`.

    Boards without engine, market or boardid don't count; a secid that lacks the preferred board has no row.
    """
    usable = boards.where("engine is not null and market is not null and boardid is not null")
    if preferred is not None:
        usable = usable.where(F.upper("boardid") == preferred.strip().upper())
    turn = Window.partitionBy("secid").orderBy(F.when(F.col("is_primary") == 1, 0).otherwise(1), "turn")
    return usable.withColumn("n", F.row_number().over(turn)).where("n = 1").drop("n", "turn")


def typed_candles(raw: DataFrame, keep: str = "last") -> DataFrame:
    """Text columns to CANDLE types (what doesn't parse is null), one row for each asset and begin: the last or first loaded."""
    require_columns(raw, {"asset", "begin", "open", "high", "low", "close"})
    number = [(F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")).alias(c) for c in ("open", "high", "low", "close", "volume", "value")]
    load = F.col("load") if "load" in raw.columns else F.monotonically_increasing_id()
    rows = raw.select("asset", F.try_to_timestamp(F.col("begin").cast("string")).cast("timestamp_ntz").alias("begin"), *number, load.alias("load"))
    first = Window.partitionBy("asset", "begin").orderBy(F.desc("load") if keep == "last" else F.asc("load"))
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "load")


def concatenated_pages(pages: list[DataFrame]) -> DataFrame:
    """All pages of a listing, the later ones loaded later; duplicates keep their last row."""
    out = None
    for k, page in enumerate(pages):
        page = page.withColumn("load", F.lit(k))
        out = page if out is None else out.unionByName(page, allowMissingColumns=True)
    if out is None:
        raise ValueError("no pages")
    return typed_candles(out)


def read_candle_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV or gzipped CSV files; an asset for each file, named like it."""
    raw = spark.read.option("header", True).csv(path).withColumn("asset", _asset_of(F.col("_metadata.file_name")))
    return typed_candles(raw.withColumnsRenamed({c: c.lower() for c in raw.columns}), keep="first")


def _asset_of(name: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"(?i)(\.csv)?(\.gz)?$", ""))


def _unzipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["begin", "open", "high", "low", "close", "volume", "value"]
    for batch in batches:
        for payload in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(payload)) as archive:
                for k, member in enumerate(sorted(archive.namelist())):
                    low = member.lower()
                    if not low.endswith((".csv", ".csv.gz")) or not ("/candles/" in f"/{low}" or "candle" in low):
                        continue
                    try:
                        rows = pd.read_csv(io.BytesIO(archive.read(member)), dtype=str, compression="gzip" if low.endswith(".gz") else None)
                    except (ValueError, OSError, UnicodeDecodeError):
                        continue
                    rows.columns = [c.lower() for c in rows.columns]
                    if not {"begin", "open", "high", "low", "close", "volume"} <= set(rows.columns):
                        continue
                    asset = re.sub(r"(\.csv)?(\.gz)?$", "", member.rsplit("/", 1)[-1], flags=re.IGNORECASE).upper()
                    out = rows.reindex(columns=names).astype(object)
                    out = out.where(out.notna(), None)
                    yield out.assign(asset=asset, load=range(len(out)))[["asset", *names, "load"]]


def read_candle_zips(spark: SparkSession, path: str) -> DataFrame:
    """ZIP archives of candle CSV files, unpacked by the executors; unreadable members are skipped."""
    files = spark.read.format("binaryFile").load(path).select("content")
    raw = files.mapInPandas(_unzipped, "asset string, begin string, open string, high string, low string, close string, volume string, value string, load long")
    return typed_candles(raw, keep="first")


def write_candle_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header for each asset's folder."""
    df.repartition("asset").write.partitionBy("asset").option("header", True).mode("overwrite").csv(path)
