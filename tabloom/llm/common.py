"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import scratch_path

# Texts handed to Python are read in slices of at most this many bytes.
SLICE_BYTES = 16 << 20

T = TypeVar("T")
_held: dict = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """The tables of an operator in this Python worker, made when first asked for.

    They serve all tasks that the worker runs for that operator. A worker keeps the tables of one operator at a time: the
    next operator that asks lets go of those before.
    """
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Let go of the tables of the operator before, and give their memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Free memory goes back to the system, where the C library can do that; a worker would keep it until its end."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over record batches that keeps nothing in its worker: neither what was held before it nor its own memory."""

    def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        give_back()

    return thrifty


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The copy survives lost executors, cuts the lineage, and gives the optimizer the
    true size of the table, so that a later join broadcasts it only if it is small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def as_rows(df: DataFrame) -> Column:
    """All columns of a table packed into one, safe from clashing names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def whole_utf8(data: bytes) -> bytes:
    """The bytes of a text, with U+FFFD in place of what is not UTF-8."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()
    return data


def in_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the values of a binary column stay under ``limit``
    bytes per piece (a single longer value is a piece of its own)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        for i in range(len(values)):
            n = values[i].as_buffer().size if values[i].is_valid else 0
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(values):
            yield batch.slice(start)


def per_text(
    df: DataFrame, make: Callable[[], Callable[[bytes], tuple]], schema: str, text: str = "_text"
) -> DataFrame:
    """Run a function over every whole text, keeping the other columns.

    ``make`` is called once per task and returns the function from the UTF-8 bytes
    of a text to a tuple with the columns of ``schema``. The other columns pass
    through; ``text`` does not.
    """
    kept = [f for f in df.schema if f.name != text]
    fields = T_fields(schema)
    out = _arrow_schema(kept + fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in in_slices(batches, text):
            results = [fn(v or b"") for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            made = list(zip(*results)) if results else [()] * len(fields)
            columns += [pa.array(made[i], out.field(len(names) + i).type) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, out)], schema=out)

    whole = F.col(text).cast("binary") if dict(df.dtypes)[text] != "binary" else F.col(text)
    ready = df.select(*names, whole.alias(text))
    return ready.mapInArrow(run, _spark_schema(kept + fields))


def T_fields(schema: str):
    from pyspark.sql import types as T

    return list(T.StructType.fromDDL(schema))


def _spark_schema(fields):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_spark_schema(fields))
