"""Tables inside JSON payloads, read where the payloads are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<columns:array<string>,data:array<array<string>>>"


def payload_tables(payloads: DataFrame, table: str, payload_col: str = "payload") -> DataFrame:
    """A row for each row of the table in each payload {table: {columns: [...], data: [[...]]}}: all other columns of
    `payloads`, turn (from 0) and `row`, a map from lower-case column names to values as strings.

    A payload whose table is missing, or isn't made of lists of columns and data, is an error, as is a row of another
    length than the columns. A table without rows gives none.
    """
    block = F.from_json(payload_col, f"struct<`{table}`:{BLOCK}>")[table]
    sound = block.isNotNull() & F.coalesce(block["columns"].isNotNull(), F.lit(False)) & F.coalesce(block["data"].isNotNull(), F.lit(False))
    checked = payloads.withColumn("_block", F.when(sound, block).otherwise(_error(f"no table '{table}' of columns and data in the payload")))
    names = F.transform(F.col("_block.columns"), lambda c: F.lower(c))
    own = [c for c in payloads.columns if c != payload_col]
    parts = checked.select(*own, names.alias("_names"), F.col("_block.data").alias("_data"))  # else each row carries its whole block
    each = parts.select(*own, "_names", F.posexplode("_data").alias("turn", "_row"))
    fits = F.size("_row") == F.size("_names")
    return each.withColumn("row", F.when(fits, F.map_from_arrays("_names", "_row")).otherwise(_error("a row has another length than the columns"))).drop("_names", "_row")


def _error(text: str) -> Column:
    return F.raise_error(F.lit(text))


def payload_columns(payloads: DataFrame, table: str, columns: list[str], payload_col: str = "payload") -> DataFrame:
    """`payload_tables` with the named columns (null where a payload's table lacks one) in place of the map."""
    rows = payload_tables(payloads, table, payload_col)
    return rows.select(*[c for c in rows.columns if c != "row"], *[F.col("row")[c.lower()].alias(c) for c in columns])
