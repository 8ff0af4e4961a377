"""Session helpers: shared scratch space and settling of small result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Per-class and per-column tables up to this many rows, with texts up to this many characters, are held by
# the driver and broadcast; larger ones stay distributed.
SMALL_ROWS = 20_000
SMALL_CHARS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A session without that setting uses a folder in its warehouse, which the
    executors of a cluster share as well.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(configured or f"{warehouse}/tabloom-scratch")
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A small driver-side table. Handed over as Arrow it becomes a local relation
    with a known size, instead of an RDD of pickled rows."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def stored(df: DataFrame, name: str = "settled") -> DataFrame:
    """The table, written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_driver(df: DataFrame, limit: int, most_chars: int) -> DataFrame | None:
    """The table rebuilt from driver rows, or None if it is not small."""
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for f in df.schema):
        return None
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    cut = [F.substring(F.col(f"`{f.name}`"), 1, most_chars + 1).alias(f.name) if f.name in texts else F.col(f"`{f.name}`") for f in df.schema]
    rows = df.select(*cut).limit(limit + 1).collect()
    places = [i for i, f in enumerate(df.schema) if f.name in texts]
    if len(rows) > limit or any(r[i] is not None and len(r[i]) > most_chars for r in rows for i in places):
        return None
    return local_table(df.sparkSession, [tuple(r) for r in rows], df.schema)


def settle(df: DataFrame, limit: int = SMALL_ROWS, most_chars: int = SMALL_CHARS) -> tuple[DataFrame, bool]:
    """Compute a per-group table once and cut its lineage.

    Returns ``(table, small)``. A table of at most ``limit`` rows whose texts have at most ``most_chars`` characters each is
    small: it is rebuilt from driver rows and may be broadcast. Any other is written to the shared folder as
    Parquet, read back, and must be joined by shuffle. Texts reach the driver cut, so what it takes is bounded in bytes too.
    """
    few = _in_driver(df, limit, most_chars)
    return (stored(df), False) if few is None else (few, True)


def settle_stored(df: DataFrame, limit: int = SMALL_ROWS, most_chars: int = SMALL_CHARS) -> tuple[DataFrame, bool]:
    """As ``settle``, for counts per value of a column of the input: they may shuffle as much as the column holds, so they
    are written before they are looked at, and never computed twice."""
    kept = stored(df)
    few = _in_driver(kept, limit, most_chars)
    return (kept, False) if few is None else (few, True)
