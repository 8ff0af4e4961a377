"""Positions in a sorted table without sorting it in one task.

The rows are cut into ranges and sorted inside each; every range knows its size; the sums of the sizes before a range are added
to the places inside it. Sizes are one number per task, so what the driver adds up does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import quoted
from tabloom.session import local_table, scratch_path

# ``monotonically_increasing_id`` numbers rows within a task in the lower bits.
PLACE_BITS = 33


def positions(df: DataFrame, order: Sequence[Column | str], into: str = "pos", within: Sequence[str] = ()) -> DataFrame:
    """The rows with their 0-based position in ``order`` as long column ``into``; inside each ``within`` group if given.

    ``order`` must tell all rows apart, or ties are numbered in any order. The sorted table is written to the shared folder
    once, so a number never changes when a task is repeated.
    """
    spark = df.sparkSession
    keys = [*[F.col(quoted(c)) for c in within], *[F.col(quoted(c)) if isinstance(c, str) else c for c in order]]
    path = scratch_path(spark, "positions")
    # The id is made after the sort, in the task that holds the range.
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_range", F.shiftright("_place", PLACE_BITS))
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())
    offsets, before = [], 0
    for number, size in sizes:
        offsets.append((number, before))
        before += size
    # One row per task of the sort.
    table = local_table(spark, offsets, "_range bigint, _before bigint")
    place = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + F.col("_before")
    columns = [quoted(c) for c in df.columns]
    numbered = placed.join(F.broadcast(table), "_range").select(*columns, place.alias(into))
    if not within:
        return numbered
    names = [f"_w{i}" for i in range(len(within))]
    first = numbered.groupBy(*[F.col(quoted(c)).alias(n) for c, n in zip(within, names)]).agg(F.min(into).alias("_first"))
    same = [F.col(quoted(c)).eqNullSafe(F.col(n)) for c, n in zip(within, names)]
    met = numbered.join(first, same)
    return met.select(*columns, (F.col(quoted(into)) - F.col("_first")).alias(into))
