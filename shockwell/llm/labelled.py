"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most, taken in the order of a hash of the id; each fit's documented bound.
MOST_TRAINING_ROWS = 20_000


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int = MOST_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most `most` labelled rows outside the held-out fold.

    Rows without id, label or text take no part; an id labelled twice takes its larger label; of an id's several texts
    the one with the smallest hash is taken, so an id that half of the rows share adds one row.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out))
    one = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    sample = one.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("label").alias("label"))
