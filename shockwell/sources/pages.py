"""Paged candle listings: a data source whose input partitions are pages, and the joined market-data load over it.

A listing is a folder of JSON pages as an exchange serves them, {candles: {columns: [...], data: [[...]]}}, one for each
asset, interval and offset. Asset and interval, and a page's first and last begin, stand in its path, so a filter keeps
pages from being listed and read; what the schema doesn't ask for isn't parsed.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from shockwell.sources.candles import INTERVALS, PayloadError, normalized_symbol, resolve_route, typed_candles

#: Columns of a listing: the path gives asset and interval, the page the candle, its place the load order.
LISTING = "asset string, interval int, begin timestamp_ntz, open double, high double, low double, close double, volume double, value double, load long"
#: Fixed value: how a page's first and last begin are written in its path.
STAMP = "%Y%m%d%H%M%S"
PAGE = re.compile(r"start=(\d+)/first=(\d{14})/last=(\d{14})/")
#: Pages that one task reads.
PAGES_A_TASK = 16


def write_pages(candles: DataFrame, path: str, interval: int, page_size: int = 500) -> None:
    """Candles (asset, begin, ...) as a listing of pages of `page_size` in the order of begin; one JSON document for each."""
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")
    names = [c for c in ("begin", "open", "high", "low", "close", "volume", "value") if c in candles.columns]
    row = F.array(*[F.col(c).cast("string") for c in names])
    page = F.floor(F.col("pos") / page_size).cast("long")
    pages = candles.groupBy("asset", (page * page_size).alias("start")).agg(
        F.date_format(F.min("begin"), "yyyyMMddHHmmss").alias("first"), F.date_format(F.max("begin"), "yyyyMMddHHmmss").alias("last"), F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))).alias("rows")
    )
    body = F.to_json(F.struct(F.struct(F.array(*[F.lit(c) for c in names]).alias("columns"), F.transform("rows", lambda r: r["row"]).alias("data")).alias("candles")))
    pages.select("asset", F.lit(interval).alias("interval"), "start", "first", "last", body.alias("value")).write.partitionBy("asset", "interval", "start", "first", "last").text(path)


@dataclass
class Page(InputPartition):
    """Files of one asset and interval, each with its offset."""

    asset: str
    interval: int
    files: list[tuple[int, str]]


@dataclass
class Bounds:
    """What the pushed filters leave: assets and intervals (None: all), and the range of begin."""

    assets: set | None = None
    intervals: set | None = None
    ranges: list[tuple[str, datetime]] = field(default_factory=list)

    def take(self, column: str, values: set) -> None:
        name = "assets" if column == "asset" else "intervals"
        own = getattr(self, name)
        setattr(self, name, values if own is None else own & values)

    def page(self, first: str, last: str) -> bool:
        """Whether a page may hold a row in the range."""
        a, b = datetime.strptime(first, STAMP), datetime.strptime(last, STAMP).replace(microsecond=999999)
        return all((b > v if op == ">" else b >= v if op == ">=" else a < v if op == "<" else a <= v) for op, v in self.ranges)


class CandlePageReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        self.a_task = int(options.get("pagespertask", PAGES_A_TASK))
        self.bounds = Bounds()

    def pushFilters(self, filters: list) -> Iterable:
        """Equality and lists of asset and interval, and ranges of begin, are taken over whole; the rest is left to Spark."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("asset", "interval") and isinstance(f, (EqualTo, In)):
                self.bounds.take(column, set(f.value) if isinstance(f, In) else {f.value})
            elif column == "begin" and isinstance(f, EqualTo):
                self.bounds.ranges += [(">=", f.value), ("<=", f.value)]
            elif column == "begin" and type(f) in signs:
                self.bounds.ranges.append((signs[type(f)], f.value))
            else:
                yield f

    def _folders(self, fs: Any, at: str, key: str) -> list[tuple[str, str]]:
        from urllib.parse import unquote

        from pyarrow.fs import FileSelector, FileType

        found = fs.get_file_info(FileSelector(at, allow_not_found=True))
        return sorted((unquote(posixpath.basename(x.path)[len(key) + 1 :]), x.path) for x in found if x.type == FileType.Directory and posixpath.basename(x.path).startswith(f"{key}="))

    def partitions(self) -> list[InputPartition]:
        """Pages by asset and interval, `pagespertask` in a partition; folders that a filter rules out aren't listed."""
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.path)
        out: list[InputPartition] = []
        for asset, folder in self._folders(fs, root, "asset"):
            if self.bounds.assets is not None and asset not in self.bounds.assets:
                continue
            for interval, inner in self._folders(fs, folder, "interval"):
                if self.bounds.intervals is not None and int(interval) not in self.bounds.intervals:
                    continue
                files = []
                for x in fs.get_file_info(FileSelector(inner, recursive=True)):
                    where = PAGE.search(x.path)
                    if x.type == FileType.File and where and not posixpath.basename(x.path).startswith((".", "_")) and self.bounds.page(where[2], where[3]):
                        files.append((int(where[1]), x.path))
                files.sort()
                out += [Page(asset, int(interval), files[k : k + self.a_task]) for k in range(0, len(files), self.a_task)]
        return out or [Page("", 0, [])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.path)
        for start, name in partition.files:
            with fs.open_input_stream(name) as stream:
                yield self._parsed(json.loads(stream.read()), partition, start)

    def _parsed(self, body: Any, page: Page, start: int) -> pa.RecordBatch:
        """A page's rows in the range, in the columns asked for; what doesn't parse is null."""
        import numpy as np
        import pandas as pd

        block = body.get("candles") if isinstance(body, dict) else None
        if not isinstance(block, dict) or not isinstance(block.get("columns", []), list) or not isinstance(block.get("data", []), list):
            raise PayloadError("no table 'candles' of columns and data in the page")
        rows = pd.DataFrame(block.get("data", []), columns=[str(c).lower() for c in block.get("columns", [])])
        begin = pd.to_datetime(rows["begin"], errors="coerce") if "begin" in rows and ("begin" in self.names or self.bounds.ranges) else None
        keep = np.ones(len(rows), bool)
        for sign, value in self.bounds.ranges:
            at = pd.Timestamp(value)
            keep &= (False if begin is None else begin > at if sign == ">" else begin >= at if sign == ">=" else begin < at if sign == "<" else begin <= at)
        own = {
            "asset": lambda: pa.array([page.asset] * len(rows), pa.string()),
            "interval": lambda: pa.array(np.full(len(rows), page.interval, np.int32)),
            "load": lambda: pa.array(start + np.arange(len(rows))),
            "begin": lambda: pa.array(begin if begin is not None else [None] * len(rows), pa.timestamp("us")),
        }
        arrays = [own[c]() if c in own else pa.array([_number(x) for x in rows[c]] if c in rows else [None] * len(rows), pa.float64()) for c in self.names]
        return pa.RecordBatch.from_arrays(arrays, self.names).filter(pa.array(keep))


def _number(x: Any) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


class CandlePages(DataSource):
    """spark.read.format("candle_pages").load(path): option pagesPerTask; a narrower schema reads fewer columns."""

    @classmethod
    def name(cls) -> str:
        return "candle_pages"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CandlePageReader(self.options, schema)


def read_pages(spark: SparkSession, path: str, columns: list[str] | None = None, pages_per_task: int = PAGES_A_TASK) -> DataFrame:
    """The listing at `path` (a URI that executors can open), with the given columns of LISTING. Filters on it are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CandlePages)
    whole = T._parse_datatype_string(LISTING)
    schema = T.StructType([whole[c] for c in columns]) if columns else whole
    return spark.read.format("candle_pages").schema(schema).option("pagesPerTask", pages_per_task).load(path)


def load_candles(spark: SparkSession, path: str, start: str, end: str, interval: int = 24, assets: list[str] | None = None) -> DataFrame:
    """CANDLE rows of one interval from the day `start` to the day `end`, that day included: of several rows of an asset and
    begin the one loaded last stays. Only pages of the interval, the assets and the days are read."""
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")
    rows = read_pages(spark, path).where((F.col("interval") == interval) & (F.col("begin") >= F.lit(start).cast("timestamp_ntz")) & (F.col("begin") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    if assets is not None:
        rows = rows.where(F.col("asset").isin(assets))
    return typed_candles(rows, keep="last")


def load_market_data(symbols: DataFrame, boards: DataFrame, path: str, start: str, end: str, interval: int = 24, preferred: str | None = None) -> DataFrame:
    """Candles of every symbol, with its route: secid, board, engine, market and the CANDLE columns.

    Symbols (a column `symbol`) are trimmed, upper-cased and put under the name they are listed by; each takes its preferred
    or primary board, and the candles of its listing. Symbols without a board, and boards without candles, give no rows.
    """
    spark = symbols.sparkSession
    wanted = symbols.select(normalized_symbol(F.col("symbol")).alias("secid")).distinct()
    routes = resolve_route(boards.join(wanted, "secid", "left_semi"), preferred).select(F.col("secid"), F.col("boardid").alias("board"), "engine", "market")
    return load_candles(spark, path, start, end, interval).join(routes, F.col("asset") == F.col("secid")).drop("asset")
