"""Token files: raw id payloads in shards, and minimal perfect hash indexes from document keys to shards and offsets.

Files are rows of Parquet, which every store that Spark writes to can hold and commit. `shards` holds
`part` and `shard` (the order of shards), `n_docs`, `n_null` (its first documents, whose key is null), `n_tokens`, `width`
(bytes of an id), `payload` (raw little-endian ids of its documents, one after another), `keys` (64-bit keys in payload
order, without the null ones), `ends` (64-bit end of each document in the payload, in ids) and `index` (key -> first
document with it). `index` holds buckets of keys by hash: `bucket` and `index` (key -> part and shard of its first
document). So a key is found by one bucket, one shard and two lookups, however many documents there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockwell.llm.batches import local_table
from shockwell.llm.mph import PerfectIndex
from shockwell.llm.tokens import default_tokenizer, encoder

#: A shard is closed once its payload has so many bytes; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Keys in a bucket of the index, about. A key's place there is part * SHARDS + shard.
BUCKET_KEYS, SHARDS = 100_000, 1 << 32
SHARD = "part int, shard int, n_docs long, n_null long, n_tokens long, width int, payload binary, keys binary, ends binary, index binary"
BUCKETS = "bucket int, buckets int, index binary"
#: Each row of Parquet is a row group of its own, so that a lookup reads one shard and not its neighbours.
ROW_GROUPS = {"parquet.block.size": "65536", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def _shard(part: int, shard: int, keys: list[int | None], ids: list[bytes], width: int) -> pd.DataFrame:
    own = np.array([k for k in keys if k is not None], "<i8")
    ends = np.cumsum(np.array([len(x) for x in ids], "<i8") // width)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])
    row = (part, shard, len(keys), len(keys) - len(own), ends[-1], width, b"".join(ids), own.tobytes(), ends.astype("<i8").tobytes(), PerfectIndex.build(own[first], first).dump())
    return pd.DataFrame([row], columns=[x.split()[0] for x in SHARD.split(", ")])


def _write(path: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(path)
        end = np.array([end_id], code.dtype).tobytes()
        part, shard, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for k in range(0, len(batch), 256):
                rows = batch.iloc[k : k + 256]
                texts = [x if isinstance(x, str) else "" for x in rows["text"]]
                for key, raw in zip(rows["key"].astype("object").tolist(), code.encode(texts), strict=True):
                    keys.append(None if key is None or key != key else int(key))
                    ids.append(raw + end)
                    held += len(raw) + len(end)
                    if held >= shard_bytes:
                        yield _shard(part, shard, keys, ids, code.width)
                        shard, keys, ids, held = shard + 1, [], [], 0
        if keys:
            yield _shard(part, shard, keys, ids, code.width)

    return run


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(8)), F.lit(buckets)).cast("int")


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            keys = np.unique(np.frombuffer(row.keys, "<i8"))
            yield pd.DataFrame({"key": keys, "place": row.part * SHARDS + row.shard})


def _index(buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        index = PerfectIndex.build(rows["key"].to_numpy(np.int64), rows["place"].to_numpy(np.int64))
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].astype("int32"), "buckets": np.int32(buckets), "index": [index.dump()]})

    return run


def write_token_files(docs: DataFrame, to: str, end_id: int = 0, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append `end_id` and write shards and their index to the folder `to`, in ascending order of
    the key.

    Keys are dealt to partitions by range, so the partitions, and the shards within each, follow the keys' order. Null
    text is an empty one; a null key sorts first and isn't indexed; rows that share a key follow each other, in the order
    of their texts. An empty table leaves files without shards; other columns are ignored.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    dealt.mapInPandas(_write(path, end_id, shard_bytes), SHARD).write.options(**ROW_GROUPS).parquet(f"{to}/shards")
    shards = spark.read.schema(SHARD).parquet(f"{to}/shards")
    buckets = max(1, -(-int(shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]) // BUCKET_KEYS))
    places = shards.select("part", "shard", "keys").mapInPandas(_places, "key long, place long").groupBy("key").agg(F.min("place").alias("place"))
    index = places.withColumn("bucket", _bucket(F.col("key"), buckets)).groupBy("bucket").applyInPandas(_index(buckets), BUCKETS)
    index.write.options(**ROW_GROUPS).parquet(f"{to}/index")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            keys, ends = np.frombuffer(row.keys, "<i8"), np.frombuffer(row.ends, "<i8")
            at = PerfectIndex.load(row.index).find(keys)
            first = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
            at = at + (np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)))  # the key's first document, then those after it
            at = np.concatenate((np.arange(row.n_null), at + row.n_null))
            ids = np.frombuffer(row.payload, f"<u{row.width}")
            starts = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(ids[starts[i] : ends[i]].astype("<u4").tobytes()) for i in at.tolist()]
            named = pd.array(np.concatenate((np.zeros(row.n_null, np.int64), keys)), "Int64")
            named[: row.n_null] = pd.NA
            yield pd.DataFrame({"part": row.part, "shard": row.shard, "key": named, "within": starts[at], "n_tokens": ends[at] - starts[at], "ids_crc32": crc})


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files, each looked up through its shard's index.

    start counts the ids of all documents before it: sums over a part's shards, and over the parts before, of which
    there are as many as partitions were written. A part that an empty range left without rows has no shards.
    """
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("outside"))
    starts = sums.join(parts, "part").select("part", "shard", (F.col("inside") + F.col("outside")).alias("before"))
    columns = ["part", "shard", "n_null", "width", "payload", "keys", "ends", "index"]
    found = shards.select(*columns).mapInPandas(_read, "part int, shard int, key long, within long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "shard"]).select("key", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of an index bucket and the keys wanted from it."""
    for batch in batches:
        for row in batch.itertuples():
            place = PerfectIndex.load(row.index).find(np.array(row.keys, np.int64))
            yield pd.DataFrame({"key": np.array(row.keys)[place >= 0], "part": (place[place >= 0] // SHARDS).astype("int32"), "shard": (place[place >= 0] % SHARDS).astype("int32")})


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a shard and the keys wanted from it."""
    for batch in batches:
        for row in batch.itertuples():
            keys, ends = np.frombuffer(row.keys, "<i8"), np.frombuffer(row.ends, "<i8")
            ids = np.frombuffer(row.payload, f"<u{row.width}")
            found = PerfectIndex.load(row.index).find(np.array(row.wanted, np.int64))
            at = found[found >= 0]
            at = at[keys[at] == np.array(row.wanted, np.int64)[found >= 0]]  # a fingerprint may be right by chance
            if len(at):
                whole = (at + row.n_null).tolist()
                yield pd.DataFrame({"key": keys[at], "ids": [ids[ends[i - 1] if i else 0 : ends[i]].tolist() for i in whole]})


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) of the first document of each key that is in the files. The keys' buckets of the index name their shards,
    and only the payloads of those are read. Keys that aren't in the files give no rows."""
    wanted = sorted(set(keys))
    none = local_table(spark, "key long, ids array<long>", [])
    index = spark.read.schema(BUCKETS).parquet(f"{path}/index")
    head = index.select("buckets").first()
    if not wanted or head is None:
        return none
    asked = local_table(spark, "key long", [(k,) for k in wanted]).groupBy(_bucket(F.col("key"), head[0]).alias("bucket")).agg(F.collect_list("key").alias("keys"))
    numbers = [r["bucket"] for r in asked.select("bucket").collect()]
    places = index.where(F.col("bucket").isin(numbers)).join(F.broadcast(asked), "bucket").select("index", "keys").mapInPandas(_locate, "key long, part int, shard int").collect()
    if not places:
        return none
    spots = local_table(spark, "key long, part int, shard int", [tuple(r) for r in places]).groupBy("part", "shard").agg(F.collect_list("key").alias("wanted"))
    some = F.col("part").isin(sorted({r["part"] for r in places})) & F.col("shard").isin(sorted({r["shard"] for r in places}))
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards").where(some).join(F.broadcast(spots), ["part", "shard"])
    return shards.select("n_null", "width", "payload", "keys", "ends", "index", "wanted").mapInPandas(_find, "key long, ids array<long>")
