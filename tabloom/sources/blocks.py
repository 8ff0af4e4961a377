"""Records of large text files, read by many tasks where a record may contain its own separator.

Spark's text source hands out a file in blocks, each a run of pieces that end at a separator: line feeds for CSV, closing braces for
JSON. Whether a piece ends a record depends on everything before it: it may lie inside a quoted cell or string. So:

1. Every block tells, for both ways it may begin (outside or inside quotes), how it ends and by how much the nesting has changed.
2. A prefix scan over the blocks of a file, one row per block, fixes how each block really begins.
3. Every block cuts its records. What lies before its first and after its last border are fragments, put together per
   record with a running count of beginnings; only fragments move between tasks.

The parsed records are written once as Parquet to the shared folder, so later passes read columns, not text.

Blocks are those of ``spark.sql.files.maxPartitionBytes``, or of ``block_bytes``. Compressed files are one block each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import scratch_path

OUTSIDE, INSIDE = 0, 1
WHOLE, BEGIN, END, MIDDLE = 0, 1, 2, 3
# What a table of block beginnings may hold to be broadcast: 24 bytes a row, one row per block.
MOST_BLOCKS = 8_000_000
MAPS = "file bigint, start bigint, state0 bigint, nesting0 bigint, state1 bigint, nesting1 bigint"
CUT = "file bigint, start bigint, part int, first boolean, text binary"


@dataclass(frozen=True)
class Format:
    """How pieces of a format make records.

    ``step`` maps a piece and the state before it to the state after it and the change of nesting. A record ends after a piece
    outside quotes at nesting ``rest`` or less. ``join`` gives the text of some pieces of a record in a row, ``glue`` joins such texts,
    ``empty`` tells texts that are no record. ``mark``: pieces without it change nothing (None: all may).
    """

    separator: str
    step: Callable[[bytes, int], tuple[int, int]]
    rest: int
    join: Callable[[list[bytes]], bytes]
    glue: str
    empty: Callable[[bytes], bool]
    mark: str | None = None


def csv_step(line: bytes, state: int, quote: bytes = b'"', comma: bytes = b",") -> tuple[int, int]:
    """A quote opens a cell only at its beginning; inside, two quotes are one character; other quotes mean nothing."""
    if quote not in line:
        return state, 0
    parts = line.split(quote)
    k, last = 1, len(parts) - 1
    while k <= last:
        if state == OUTSIDE:
            before = parts[k - 1]
            state = INSIDE if before.endswith(comma) or (k == 1 and not before) else OUTSIDE
        elif k < last and not parts[k]:
            k += 1
        else:
            state = OUTSIDE
        k += 1
    return state, 0


_STRING = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_STRING_END = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)


def json_step(piece: bytes, state: int) -> tuple[int, int]:
    """Strings and brackets of a piece that ends at a closing brace (which is not part of it)."""
    if state == INSIDE:
        closed = _STRING_END.match(piece)
        if closed is None:
            return INSIDE, 0
        piece = piece[closed.end():]
    piece = _STRING.sub(b"", piece)
    opened = piece.find(b'"')
    if opened >= 0:
        piece = piece[:opened]
    nesting = piece.count(b"{") + piece.count(b"[") - piece.count(b"]")
    return (INSIDE, nesting) if opened >= 0 else (OUTSIDE, nesting - 1)


CSV = Format("\n", csv_step, 0, b"\n".join, "\n", lambda text: not text.strip(), '"')
JSON = Format("}", json_step, 1, lambda pieces: b"".join(p + b"}" for p in pieces), "", lambda text: b"{" not in text)


def _pieces(reader: SparkSession, path: str, form: Format) -> DataFrame:
    """``(value, file, start)``: pieces in order within a block, a block being the hash of a file's path and its first byte."""
    text = reader.read.option("lineSep", form.separator).text(path)
    return text.select(
        F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Blocks of a batch in a row, with their first and last place."""
    file, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    if not len(file):
        return
    borders = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    edges = [0, *borders.tolist(), len(file)]
    for a, b in zip(edges, edges[1:]):
        yield (int(file[a]), int(start[a])), a, b


def _block_maps(form: Format):
    """One row per block: state after it and change of nesting, from both states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, [(OUTSIDE, 0), (INSIDE, 0)]
        rows = []
        for batch in batches:
            for block, a, b in _runs(batch):
                if block != key:
                    if key is not None:
                        rows.append((*key, *ends[0], *ends[1]))
                    key, ends = block, [(OUTSIDE, 0), (INSIDE, 0)]
                for piece in batch.column(0).slice(a, b - a).drop_null().to_pylist():
                    if ends[0] == ends[1]:
                        state, change = form.step(piece, ends[0][0])
                        ends = [(state, ends[0][1] + change)] * 2
                    else:
                        ends = [(state, nesting + change) for (old, nesting) in ends for state, change in [form.step(piece, old)]]
        if key is not None:
            rows.append((*key, *ends[0], *ends[1]))
        columns = list(zip(*rows)) if rows else [()] * 6
        names = ["file", "start", "state0", "nesting0", "state1", "nesting1"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _beginnings(maps: DataFrame) -> DataFrame:
    """``(file, start, state, nesting)`` of the blocks that do not begin outside everything.

    A block either ends in one state however it begins (a constant), keeps the state or turns it. Before a block the state is that after
    the last constant, turned as often as blocks since then turn it.
    """
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    turns = F.coalesce(F.sum(((F.col("state0") == INSIDE) & (F.col("state1") == OUTSIDE)).cast("long")).over(before), zero)
    turned = maps.withColumn("_turns", turns)
    anchor = F.when(F.col("state0") == F.col("state1"), (F.col("state0") + F.col("_turns")) % 2)
    known = turned.withColumn("_anchor", F.coalesce(F.last(anchor, ignorenulls=True).over(before), zero))
    stated = known.withColumn("state", (F.col("_anchor") + F.col("_turns")) % 2)
    change = F.when(F.col("state") == INSIDE, F.col("nesting1")).otherwise(F.col("nesting0"))
    nested = stated.withColumn("nesting", F.coalesce(F.sum(change).over(before), zero))
    return nested.select("file", "start", "state", "nesting").filter("state <> 0 OR nesting <> 0")


def _cut(form: Format):
    """Records and fragments of blocks; rows of ``CUT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, state, nesting, head, first, open_pieces = None, OUTSIDE, 0, False, False, []

        def emit(part: int) -> bool:
            text = form.join(open_pieces)
            if part == WHOLE and form.empty(text):
                return False
            rows.append((*key, part, first, text))
            return True

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "part", "first", "text"])

        for batch in batches:
            for block, a, b in _runs(batch):
                if block != key:
                    if open_pieces:
                        emit(MIDDLE if head else BEGIN)
                    key, open_pieces, first = block, [], block[1] == 0
                    state, nesting = (batch.column(i)[a].as_py() or 0 for i in (3, 4))
                    head = state != OUTSIDE or nesting > form.rest
                for piece in batch.column(0).slice(a, b - a).to_pylist():
                    state, change = form.step(piece, state)
                    nesting += change
                    open_pieces.append(piece)
                    if state == OUTSIDE and nesting <= form.rest:
                        if emit(END if head else WHOLE):
                            first = False
                        head, open_pieces = False, []
            yield batch_of()
            rows.clear()
        if open_pieces:
            emit(MIDDLE if head else BEGIN)
        yield batch_of()

    return run


def _stitched(fragments: DataFrame, glue: str) -> DataFrame:
    """``(first, text)`` of the records that cross block borders: a beginning and all fragments up to the next one."""
    place = F.struct("start", (F.col("part") == BEGIN).cast("int").alias("late"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("file").orderBy("start", (F.col("part") == BEGIN).cast("int"))
    numbered = fragments.select("file", F.sum((F.col("part") == BEGIN).cast("long")).over(order).alias("record"), "first", "part", place.alias("place"))
    whole = numbered.groupBy("file", "record").agg(
        F.max(F.col("first") & (F.col("part") == BEGIN)).alias("first"), F.array_sort(F.collect_list("place")).alias("places"))
    return whole.select("first", F.concat_ws(glue, "places.text").alias("text"))


def read_records(spark: SparkSession, path: str, form: Format, parse: Callable[[Column], Column], block_bytes: int | None = None) -> DataFrame:
    """The fields of ``parse(text)`` for every record of the files under ``path``, and the boolean ``_first``: the first record
    of its file. ``parse`` gives a struct. A record that the end of a file leaves open is given as far as it goes."""
    reader = spark
    if block_bytes is not None:
        # A session of its own holds the setting for this read only.
        reader = spark.newSession()
        reader.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    pieces = _pieces(reader, path, form)
    value = F.col("value") if form.mark is None else F.when(F.contains("value", F.lit(form.mark.encode())), F.col("value"))
    maps = _stored(spark, pieces.withColumn("value", value).mapInArrow(_block_maps(form), MAPS), "blockmaps")
    if maps.count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks; raise spark.sql.files.maxPartitionBytes")
    begins = scratch_path(spark, "begins")
    _beginnings(maps).write.parquet(begins)
    # Bounded by MOST_BLOCKS; a shuffle would lose the order of the pieces.
    begun = pieces.join(F.broadcast(reader.read.parquet(begins)), ["file", "start"], "left").select("value", "file", "start", "state", "nesting")
    text = F.col("text").cast("string")
    whole = F.when(F.col("part") == WHOLE, text)
    cut = begun.mapInArrow(_cut(form), CUT).withColumn("_record", parse(whole))
    fields = [f.name for f in cut.schema["_record"].dataType]
    rest = F.when(F.col("part") != WHOLE, F.col("text")).alias("_text")
    staged = _stored(spark, cut.select("file", "start", "part", "first", rest, *[F.col("_record")[f].alias(f) for f in fields]), "records")
    crossing = _stitched(staged.filter(F.col("part") != WHOLE).withColumnRenamed("_text", "text").select("file", "start", "part", "first", "text"), form.glue)
    crossing = crossing.filter(F.trim("text") != "").withColumn("_record", parse(F.col("text")))
    return staged.filter(F.col("part") == WHOLE).select(F.col("first").alias("_first"), *fields).unionByName(
        crossing.select(F.col("first").alias("_first"), *[F.col("_record")[f].alias(f) for f in fields]))


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder by the session of ``df`` and read back by ``spark``."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
