"""Columns computed over Arrow batches, beside a table's own columns, which pass through untouched."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of a batch that are Python objects at a time.
ROWS = 512
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def give_back() -> None:
    """Hands memory that Python and Arrow hold but don't use to the system: a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, with its task's memory given back at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def local_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A DataFrame of the driver's rows, sent as Arrow: unlike rows of Python objects it starts no Python workers."""
    fields = [f.strip().split() for f in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    table = pa.table({name: pa.array(list(values), ARROW[kind]) for (name, kind), values in zip(fields, columns, strict=True)})
    return spark.createDataFrame(table, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as it takes not to be a column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def append_columns(df: DataFrame, new: dict[str, str], make: Callable[[], Callable[..., list]], inputs: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the columns `new` (name to type) and without the columns `without`.

    `make` is called once in each task and gives a function from the batch's `inputs`, as lists, to one list for each
    new column. A column of `df` that has the name of a new one is replaced, if it isn't an input.
    """
    clash = {c.lower() for c in new} - {c.lower() for c in inputs}
    kept = [f for f in df.schema.fields if f.name.lower() not in clash]
    names = [f.name for f in kept]
    out = [f for f in kept if f.name not in without]
    schema = T.StructType(out + T._parse_datatype_string(", ".join(f"`{c}` {t}" for c, t in new.items())).fields)
    types = [ARROW[t] for t in new.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            own = [batch.column(k) for k, c in enumerate(names) if c not in without]
            found = work(*(batch.column(names.index(c)).to_pylist() for c in inputs))
            arrays = own + [pa.array(x, t) for x, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

    return df.select(*[f"`{c}`" for c in names]).mapInArrow(released(run), schema)
