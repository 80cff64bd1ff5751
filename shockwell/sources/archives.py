"""ZIP archives of candle CSV files, read and written a member at a time."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwell.sources.candles import typed_candles

#: Columns of a member; those that it must have.
COLUMNS = ["begin", "open", "high", "low", "close", "volume", "value"]
NEEDED = {"begin", "open", "high", "low", "close", "volume"}
MEMBER = "path string, member string, compressed long, size long"
#: Lines of a member that are parsed at once; unpacked bytes that one task should read.
LINES, TASK_BYTES = 50_000, 64 << 20


@contextmanager
def _opened(path: str) -> Iterator[zipfile.ZipFile]:
    """An archive at a URI, read at the places that are asked for: its directory, and the members."""
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path))
    with fs.open_input_file(name) as raw, zipfile.ZipFile(raw) as archive:
        yield archive


def _is_candles(member: str) -> bool:
    low = member.lower()
    return low.endswith((".csv", ".csv.gz")) and ("/candles/" in f"/{low}" or "candle" in low)


def _directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            with _opened(path) as archive:
                own = [(path, x.filename, x.compress_size, x.file_size) for x in archive.infolist() if not x.is_dir() and _is_candles(x.filename)]
            yield pd.DataFrame(own, columns=["path", "member", "compressed", "size"])


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """MEMBER rows: the candle files in the archives at `path`, from their directories; no member is unpacked."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(_directories, MEMBER)


def _asset_of(member: str) -> str:
    return re.sub(r"(\.csv)?(\.gz)?$", "", member.rsplit("/", 1)[-1], flags=re.IGNORECASE).upper()


def _lines_of(archive: zipfile.ZipFile, member: str) -> Iterator[pd.DataFrame]:
    """A member's rows as text, LINES at a time. One that isn't a readable table of candles gives none."""
    try:
        with archive.open(member) as packed, (gzip.open(packed) if member.lower().endswith(".gz") else packed) as raw:
            first = 0
            for part in pd.read_csv(raw, dtype=str, chunksize=LINES):
                part.columns = [c.lower() for c in part.columns]
                if not set(part.columns) >= NEEDED:
                    return
                out = part.reindex(columns=COLUMNS).astype(object)
                yield out.where(out.notna(), None).assign(load=range(first, first + len(part)))
                first += len(part)
    except (ValueError, OSError, EOFError, UnicodeDecodeError, zipfile.BadZipFile):
        return


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, members in batch.groupby("path")["member"]:
            with _opened(path) as archive:
                for member in members:
                    for rows in _lines_of(archive, member):
                        yield rows.assign(asset=_asset_of(member), source=f"{path}!{member}")[["asset", *COLUMNS, "source", "load"]]


def read_candle_archives(spark: SparkSession, path: str, assets: list[str] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """CANDLE rows of the ZIP archives at `path` (a URI, globs too), a member for each asset, named like it.

    The executors read the archives' directories first; then members, not archives, are dealt to tasks of about `task_bytes`
    of unpacked text, so one archive is read by many tasks, each from its members' places on, as a stream. With `assets`
    other members aren't opened. Members that can't be read or lack a column are skipped; an archive that can't be opened is
    an error. Of several rows of one asset and begin the first stays: by archive, member and line.
    """
    members = archive_members(spark, path)
    if assets is not None:
        members = members.where(F.upper(F.regexp_replace(F.element_at(F.split("member", "/"), -1), r"(?i)(\.csv)?(\.gz)?$", "")).isin([a.upper() for a in assets]))
    members = members.persist()
    try:
        total = members.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        tasks = max(1, min(total[1], max(-(-total[0] // task_bytes), min(total[1], spark.sparkContext.defaultParallelism))))
        dealt = members.repartition(tasks, "path", "member")
        schema = "asset string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", source string, load long"
        raw = dealt.mapInPandas(_unpacked, schema)
        return typed_candles(raw.withColumn("load", F.struct("source", "load")), keep="first")
    finally:
        members.unpersist()


def _zipped(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        name = str(rows["archive"].iloc[0])
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for asset, own in rows.sort_values(["asset", "begin"]).groupby("asset"):
                archive.writestr(zipfile.ZipInfo(f"candles/{asset}.csv"), own[[c for c in COLUMNS if c in own]].to_csv(index=False, date_format="%Y-%m-%d %H:%M:%S"))
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(posixpath.join(root, f".{name}.part")) as out:
            out.write(held.getvalue())
        fs.move(posixpath.join(root, f".{name}.part"), posixpath.join(root, f"{name}.zip"))
        return pd.DataFrame({"archive": [name], "bytes": [held.tell()]})

    return run


def write_candle_archives(df: DataFrame, folder: str, archive: Any) -> DataFrame:
    """One ZIP file under the URI `folder` for each value of the column `archive`, a CSV member for each asset; returns
    (archive, bytes). An archive's rows are one group: choose a column (a month, say) of which each value's rows fit a task."""
    rows = df.withColumn("archive", archive.cast("string"))
    done = rows.groupBy("archive").applyInPandas(_zipped(folder), "archive string, bytes long")
    return df.sparkSession.createDataFrame(done.toArrow(), done.schema)
