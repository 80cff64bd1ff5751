"""Line deduplication: lines that many documents share go, except in one document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwell.llm.batches import append_columns, fresh
from shockwell.llm.hot import join_hot
from shockwell.llm.scratch import materialise

#: White space that is stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the normalised line (stripped, A-Z lower-cased); None if it has under `min_chars` code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or len(key.decode()) < min_chars:
        return None
    return xxhash.xxh128_digest(key)


def _keys(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.iloc[k : k + 512]
                own = [{line_key(x, min_chars) for x in t.encode().split(b"\n")} - {None} if isinstance(t, str) else () for t in part["text"]]
                times = [len(x) for x in own]
                yield pd.DataFrame({"id": part["id"].astype("Int64").repeat(times).array, "mark": part["mark"].repeat(times).array, "key": [x for keys in own for x in keys]})

    return run


def _rebuild(min_chars: int):
    def work(texts: list[str | None], drops: list[list[bytes] | None]) -> list[list]:
        total, lost, kept = [], [], []
        for text, own in zip(texts, drops, strict=True):
            lines = text.encode().split(b"\n") if isinstance(text, str) else [b""]
            stay = lines
            if own is not None:
                gone = set(own)
                stay = [x for x in lines if line_key(x, min_chars) not in gone]
            total.append(len(lines))
            lost.append(len(lines) - len(stay))
            kept.append(text if len(stay) == len(lines) else b"\n".join(stay).decode())
        return [total, lost, kept]

    return lambda: work


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` with n_lines, n_dropped and kept_text for each row; columns of these names are replaced.

    Lines are split at \\n. A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at
    least `min_chars` code points that at least `min_docs` distinct ids hold lose all their lines, except in the largest
    id that holds them. Counting combines before the shuffle, and the rows of keys that very many texts hold stay where
    they are, so a line in every third document is no hot key.

    Null text: one empty line, kept_text null. Empty text: one empty line. Texts of any length are read whole. Null id:
    its rows count as one document, smaller than any other. Rows that share an id count as one document. An empty table
    gives no rows.
    """
    own_id, own_mark, own_drops = fresh(docs, "own_id", "own_mark", "own_drops")
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_mark: F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))})
    rows = keyed.select(F.col(own_id).alias("id"), F.col(own_mark).alias("mark"), F.col(text_col).cast("string").alias("text"))
    keys = materialise(rows.mapInPandas(_keys(min_chars), "id long, mark long, key binary"), "lines")
    often = (
        keys.groupBy("key")
        .agg(F.count_distinct(F.struct("id")).alias("n"), F.count("*").alias("rows"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("key", "keeper", "rows")
    )
    drops = join_hot(keys, materialise(often, "shared"), "key", "rows", keys.count()).where(~F.col("id").eqNullSafe(F.col("keeper")))
    found = drops.groupBy(F.coalesce("id", F.lit(0)).alias(own_id), F.col("mark").alias(own_mark)).agg(F.collect_set("key").alias(own_drops))
    both = keyed.withColumn(own_id, F.coalesce(own_id, F.lit(0))).join(found, [own_id, own_mark], "left").drop(own_id, own_mark)
    return append_columns(both, {"n_lines": "long", "n_dropped": "long", "kept_text": "string"}, _rebuild(min_chars), [text_col, own_drops], without=(own_drops,))
