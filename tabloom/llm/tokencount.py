"""Tokens per document from flat token files, by a scan for separators.

A token file is a bare sequence of 16-bit (or 32-bit) ids in little-endian order; each document ends with the
end-of-document id. There is no index. Files are scanned in blocks: a block's separators are found with one vectorised
comparison, which gives the documents that begin and end inside it, the tokens before its first separator, and
those after its last. A running sum over the blocks of a file numbers the documents and adds up the tokens of
those that cross block borders, over any number of blocks. Blocks are read by different tasks.

Defined cases: a document without tokens counts zero; tokens after the last separator of a file are an unfinished
document, reported with ``finished`` false; null texts count as empty; bytes that are not UTF-8 become U+FFFD; a file without tokens gives no rows;
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import bpe, files
from tabloom.llm.common import in_slices, stage, text_of, whole_utf8
from tabloom.session import scratch_path

END_OF_DOCUMENT = 50_256
BLOCK_BYTES = 4 << 20
ROLL_BYTES = 64 << 20
MANIFEST = "file string, bytes bigint, width int"


def write_token_files(
    docs: DataFrame, path: str, pattern: str, folder: str, end: int = END_OF_DOCUMENT, id_col: str = "doc_id", text_col: str = "text",
    roll: int = ROLL_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Encode every whole text into flat files. Returns the table of files and the order of the
    documents in them, ``(file, place, doc_id)``; both staged."""
    schema = MANIFEST + ", place bigint, doc_id bigint"
    width = 2 if end < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = bpe.codec(path, pattern), np.dtype("<u2" if width == 2 else "<u4")
        close = np.array([end], kind).tobytes()
        rows = (row for batch in in_slices(batches, "_text") for row in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(rows, None)
        while row is not None:
            size, ids = 0, []
            with files.writing(folder, ".tokens") as (out, name):
                while row is not None and size < roll:
                    doc_id, text = row
                    for block in coder.encode(whole_utf8(text or b"").decode()):
                        data = block.astype(kind, copy=False).tobytes()
                        out.write(data)
                        size += len(data)
                    out.write(close)
                    size += len(close)
                    ids.append(doc_id)
                    row = next(rows, None)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array([size] * n), pa.array([width] * n, pa.int32()), pa.array(range(n), pa.int64()),
                 pa.array(ids, pa.int64())],
                ["file", "bytes", "width", "place", "doc_id"])

    ready = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(f"`{text_col}`").cast("binary").alias("_text"))
    written = stage(ready.mapInArrow(run, schema), "tokenfiles")
    return written.filter("place = 0").select("file", "bytes", "width"), written.select("file", "place", "doc_id")


def _scan(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    """Per block: separators, head and tail, and the lengths of documents inside it."""
    for batch in batches:
        for file, width, block, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            with files.reading(file, seek=True) as source:
                source.seek(start)
                data = source.read(length)
            ids = np.frombuffer(data, "<u2" if width == 2 else "<u4")
            at = np.flatnonzero(ids == end)
            head = int(at[0]) if len(at) else len(ids)
            tail = len(ids) - int(at[-1]) - 1 if len(at) else len(ids)
            inside = np.diff(at) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()),
                 pa.array([tail], pa.int64()), pa.array([inside.astype(np.int64)], pa.list_(pa.int64()))],
                ["file", "block", "ends", "head", "tail", "inside"])


def count_tokens(token_files: DataFrame, end: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, place, n_tokens, finished)`` per document of the files ``(file, bytes, width)``."""
    size = F.floor(F.lit(block_bytes) / F.col("width")).cast("long") * F.col("width")
    cut = token_files.filter("bytes > 0").select("file", "width", "bytes", size.alias("size"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bytes") / size).cast("long") - 1)).alias("block"))
    blocks = cut.select("file", "width", "block", (F.col("block") * F.col("size")).alias("start"),
                        F.least("size", F.col("bytes") - F.col("block") * F.col("size")).alias("length"))
    spread = blocks.repartition(token_files.sparkSession.sparkContext.defaultParallelism * 4)
    found = stage(spread.mapInArrow(
        lambda b: _scan(b, end), "file string, block bigint, ends bigint, head bigint, tail bigint, inside array<bigint>"), "scanned")
    # Stitching: a row per block, without the documents inside it.
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = found.select("file", "block", "ends", "head", "tail")
    edges = edges.withColumn("place", F.coalesce(F.sum("ends").over(past), F.lit(0).cast("long")))
    # Tokens since the last separator, at the end of each block: a running sum that starts anew where one was met.
    edges = edges.withColumn("run", F.sum((F.col("ends") > 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("open", F.sum("tail").over(since))
    edges = edges.withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0).cast("long")))
    edges = edges.withColumn("last", F.lead("block").over(order).isNull())
    crossing = edges.filter("ends > 0").select("file", "place", (F.col("carried") + F.col("head")).alias("n_tokens"), F.lit(True).alias("finished"))
    unfinished = edges.filter("last AND open > 0").select(
        "file", (F.col("place") + F.col("ends")).alias("place"), F.col("open").alias("n_tokens"), F.lit(False).alias("finished"))
    start = edges.filter("ends > 1").select("file", "block", (F.col("place") + 1).alias("first"))
    inside = found.filter("ends > 1").select("file", "block", "inside").join(start, ["file", "block"]).select(
        "file", "first", F.posexplode("inside").alias("i", "n_tokens"))
    inside = inside.select("file", (F.col("first") + F.col("i")).alias("place"), "n_tokens", F.lit(True).alias("finished"))
    return crossing.unionAll(inside).unionAll(unfinished)


def document_tokens(docs: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    """``doc_id, n_tokens`` of every document, by writing and scanning token files."""
    folder = scratch_path(docs.sparkSession, "tokens")
    token_files, order = write_token_files(docs, path, pattern, folder, **options)
    return order.join(count_tokens(token_files), ["file", "place"]).select("doc_id", "n_tokens")
