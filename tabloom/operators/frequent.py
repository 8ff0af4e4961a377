"""Most frequent values of columns with very many values, without moving all values.

Each task keeps a bounded summary per column: a number of counters, and when there are more values than counters, a common amount is
taken off all of them and the smallest go (Misra and Gries). A value's count in the table then lies between the sum of its counters over the
tasks and that sum plus the column's error, the sum of all amounts taken off, which is at most rows / (counters + 1). Only counters move.

The values with the highest counters are counted again, exactly, in a second pass. Long texts are known by their SHA-256 until then, so
summaries and what is broadcast are bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.profile import TOP_VALUES, cells_as_text
from tabloom.session import scratch_path, settle

COUNTERS = 1_000
# Values of a column that are counted again.
CANDIDATES = 500
# Longer texts are replaced by their digest.
KEY_CHARS = 64
SUMMARY = "pos int, key string, n bigint, error bigint"


class Summary:
    """Counters of one column: at most ``most`` after each batch."""

    def __init__(self, most: int):
        self.most, self.error = most, 0
        self.counts: dict[str | None, int] = {}

    def add(self, values: list, counts: list[int]) -> None:
        mine = self.counts
        for value, n in zip(values, counts):
            mine[value] = mine.get(value, 0) + n
        if len(mine) > self.most:
            sizes = np.fromiter(mine.values(), np.int64, len(mine))
            # The largest count that no more than ``most`` values exceed is taken off all.
            amount = int(np.partition(sizes, len(sizes) - self.most - 1)[len(sizes) - self.most - 1])
            self.counts = {value: n - amount for value, n in mine.items() if n > amount}
            self.error += amount


def _summaries(counters: int):
    """Rows of ``SUMMARY`` per task: counters with error 0, and one row per column with a null count for its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[int, Summary] = {}
        for batch in batches:
            for pos in range(batch.num_columns):
                found = pc.value_counts(batch.column(pos))
                columns.setdefault(pos, Summary(counters)).add(found.field(0).to_pylist(), found.field(1).to_pylist())
        for pos, summary in columns.items():
            values, counts = [*summary.counts, None], [*summary.counts.values(), None]
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([pos] * n, pa.int32()), pa.array(values, pa.string()), pa.array(counts, pa.int64()),
                 pa.array([0] * (n - 1) + [summary.error], pa.int64())], ["pos", "key", "n", "error"])

    return run


def _key(value: str) -> str:
    """A short text that stands for a value, in SQL; null stays null."""
    return f"CASE WHEN length({value}) <= {KEY_CHARS} THEN concat('=', {value}) ELSE concat('#', sha2({value}, 256)) END"


def frequent_values(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES, counters: int = COUNTERS, candidates: int = CANDIDATES
) -> DataFrame:
    """``(column, value, n, rank, n_others)``: the k most frequent values of each column, the missing bucket included.

    ``n`` is exact. ``n_others`` is a bound on the count of every value that is not listed: the listed values are the most frequent
    ones wherever they exceed it. If no task met more than ``counters`` values of a column, nothing was taken off, and its rows are
    those of ``value_counts``. In a column without frequent values the list may hold others than the most frequent;
    ``n_others`` then tells how frequent any other could be. An empty table gives no rows.
    """
    if not k <= candidates:
        raise ValueError(f"{k} values asked for, {candidates} counted")
    names = list(columns) if columns is not None else df.columns
    spark = df.sparkSession
    cells = cells_as_text(df, names)
    keys = df.selectExpr(*[f"{_key(cell)} AS c{i}" for i, cell in enumerate(cells)])
    path = scratch_path(spark, "frequent")
    keys.mapInArrow(_summaries(counters), SUMMARY).write.parquet(path)
    found = spark.read.schema(SUMMARY).parquet(path)
    errors = found.filter("n IS NULL").groupBy("pos").agg(F.sum("error").alias("error"))
    lower = found.filter("n IS NOT NULL").groupBy("pos", "key").agg(F.sum("n").alias("low"))
    order = Window.partitionBy("pos").orderBy(F.desc("low"), F.asc_nulls_first("key"))
    # The rank limit works inside each task first.
    top = lower.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= candidates + 1)
    chosen, _ = settle(top)
    past = chosen.filter(F.col("place") == candidates + 1).select("pos", F.col("low").alias("past"))
    rest = errors.join(past, "pos", "left").select("pos", (F.coalesce("past", F.lit(0).cast("long")) + F.col("error")).alias("rest"))
    listed = chosen.filter(F.col("place") <= candidates).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"))

    pairs = ", ".join(f"struct({_key(cell)} AS key, {cell} AS value)" for cell in cells)
    tall = df.selectExpr(f"posexplode(array({pairs})) AS (pos, cell)").select("pos", "cell.key", "cell.value")
    # At most ``candidates`` rows a column, each of bounded length.
    met = tall.join(F.broadcast(listed), (F.col("pos") == F.col("_pos")) & F.col("key").eqNullSafe(F.col("_key")))
    counted = met.groupBy("pos", "key").agg(F.min("value").alias("value"), F.count("*").alias("n"))
    by_count = Window.partitionBy("pos").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    ranked = counted.select("pos", "value", "n", F.row_number().over(by_count).alias("rank")).filter(F.col("rank") <= k + 1)
    following = F.max(F.when(F.col("rank") == k + 1, F.col("n"))).over(Window.partitionBy("pos"))
    bounded = ranked.withColumn("_next", F.coalesce(following, F.lit(0).cast("long"))).join(rest, "pos")
    columns_of = F.array(*[F.lit(n) for n in names])
    return bounded.filter(F.col("rank") <= k).select(
        F.get(columns_of, F.col("pos")).alias("column"), "value", "n", "rank", F.greatest("_next", "rest").alias("n_others"))
