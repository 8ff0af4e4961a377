"""Mutual information of numeric features with classes by nearest neighbours (the estimator of Ross, 2014).

For every value, the distance to its k-th nearest value of the same class, and the number of values of any class closer than that. Both
need sorted values, a feature at a time, and no task holds a feature or a class:

1. Values are numbered in the order (feature, class, value) by ranges, and dealt in blocks of bounded size with the k rows
   beyond each end; the k nearest of a class lie within k places.
2. The numbers of values below both ends of each interval are read off one sort of values and ends together: running counts inside each
   range, plus the counts of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import quoted
from tabloom.operators.columns import drop_missing_target
from tabloom.operators.features import _ranked
from tabloom.operators.positions import positions
from tabloom.operators.quantiles import long_values
from tabloom.session import local_table, scratch_path

NEIGHBOURS = 3
BLOCK_ROWS = 200_000
INTERVALS = "id bigint, pos int, low double, high double, v double, k int"


def kth_distances(groups: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each value to its k-th nearest of the same group, and that k (fewer in small groups; 0: alone).

    Rows are sorted by group and value.
    """
    n = len(values)
    around = np.full((n, 2 * k), np.inf)
    for step in range(1, k + 1):
        if step < n:
            same = groups[step:] == groups[:-step]
            gap = np.where(same, values[step:] - values[:-step], np.inf)
            around[step:, 2 * step - 2] = gap
            around[:-step, 2 * step - 1] = gap
    around.sort(axis=1)
    near = np.minimum(k, np.isfinite(around).sum(axis=1))
    return np.where(near > 0, around[np.arange(n), np.maximum(near, 1) - 1], np.nan), near


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, without gaps; and back."""
    bits = values.view(np.int64)
    return np.where(bits >= 0, bits, np.iinfo(np.int64).min - bits)


def closer_than(values: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the interval of all numbers nearer to each value than its distance; the value alone for distance 0.

    The ends are the last numbers whose difference, as computed, is less than the distance: found by halving the
    doubles between the value and one beyond, since rounding may put many doubles at one difference.
    """
    ends = []
    for side in (-1.0, 1.0):
        inside, beyond = _ordered(values), _ordered(values + side * 2 * distances)
        while True:
            half = np.abs(side * (beyond - inside)).astype(np.int64) // 2
            if not (half > 0).any():
                break
            middle = inside + np.where(side > 0, half, -half)
            number = _ordered(middle.view(np.float64)).view(np.float64)
            near = side * (number - values) < distances
            inside, beyond = np.where(near, middle, inside), np.where(near, beyond, middle)
        number = _ordered(inside.view(np.float64)).view(np.float64)
        ends.append(np.where(distances > 0, number, values) + 0.0)
    return ends[0], ends[1]


def _intervals(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        pos, value, own, ids = (table.column(c).to_numpy() for c in ("pos", "v", "own", "id"))
        label = table.column("y").combine_chunks()
        other = pc.not_equal(label[1:], label[:-1]).to_numpy(zero_copy_only=False)
        groups = np.cumsum(np.concatenate([[0], (pos[1:] != pos[:-1]) | other]))
        distances, near = kth_distances(groups, value, k)
        mine = own & (near > 0)
        low, high = closer_than(value[mine], distances[mine])
        return pa.table({"id": ids[mine], "pos": pos[mine].astype(np.int32), "low": low, "high": high, "v": value[mine], "k": near[mine].astype(np.int32)})

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each end the values before it in this range; at last a row without id for the range."""
    part, before = TaskContext.get().partitionId(), 0
    names = ["id", "part", "n"]
    for batch in batches:
        kind, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        counts = before + np.cumsum(kind == 1)
        before = int(counts[-1]) if len(counts) else before
        ends = kind != 1
        m = int(ends.sum())
        yield pa.RecordBatch.from_arrays([pa.array(ids[ends].astype(np.int64)), pa.array([part] * m, pa.int32()), pa.array(counts[ends].astype(np.int64))], names)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([before], pa.int64())], names)


def _counts_inside(spark, intervals: DataFrame) -> DataFrame:
    """``(id, m)``: how many of the values lie between the two ends of each interval, ends included."""
    value = intervals.select("pos", F.col("v").alias("x"), F.lit(1).alias("kind"), "id")
    low = intervals.select("pos", F.col("low").alias("x"), F.lit(0).alias("kind"), "id")
    high = intervals.select("pos", F.col("high").alias("x"), F.lit(2).alias("kind"), "id")
    # With the id, equal values spread over several ranges.
    order = ["pos", "x", "kind", "id"]
    events = value.unionAll(low).unionAll(high).repartitionByRange(*order).sortWithinPartitions(*order)
    path = scratch_path(spark, "ends")
    events.select("kind", "id").mapInArrow(_running, "id bigint, part int, n bigint").write.parquet(path)
    ends = spark.read.parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in ends.filter("id IS NULL").select("part", "n").collect())
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    # One row per task of the sort.
    table = local_table(spark, offsets, "part int, before bigint")
    counted = ends.filter("id IS NOT NULL").join(F.broadcast(table), "part").select("id", (F.col("n") + F.col("before")).alias("n"))
    return counted.groupBy("id").agg((F.max("n") - F.min("n")).alias("m"))


def digamma(x: str) -> str:
    """The digamma function of a whole number from 1, in SQL: ten steps up, then its asymptotic series."""
    steps = " + ".join(f"1e0 / ({x} + {i})" for i in range(10))
    y = f"({x} + 10e0)"
    series = f"ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8))"
    return f"({series} - ({steps}))"


def rank_mutual_info_knn(
    df: DataFrame, columns: Sequence[str], y: str, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mutual information (natural log) of each feature with the classes of ``y``, by k nearest neighbours; ranked as the others are.

    Classes are compared as text. A class with one value of a feature is left out of it, missing values too. Equal values are
    at distance zero; no noise is added to part them, so scores are repeatable. A feature without values scores 0.
    """
    spark = df.sparkSession
    rows = drop_missing_target(df, y)
    tall = long_values(rows, columns, f"CAST({quoted(y)} AS STRING) AS y").withColumns({"v": F.col("v") + F.lit(0.0), "_row": F.monotonically_increasing_id()})
    # With a number of the row, equal values spread over several ranges.
    numbered = positions(tall, ["pos", "y", "v", "_row"], "id")
    block = F.floor(F.col("id") / block_rows).cast("long")
    place = F.col("id") % block_rows
    # A row near an end of its block is lent to the next one.
    lent = F.filter(F.array(F.lit(0), F.when(place < k, F.lit(-1)), F.when(place >= block_rows - k, F.lit(1))), lambda s: s.isNotNull())
    dealt = numbered.select("id", "pos", "y", "v", block.alias("home"), F.explode(lent).alias("shift"))
    dealt = dealt.select("id", "pos", "y", "v", (F.col("home") + F.col("shift")).alias("block"), (F.col("shift") == 0).alias("own"))
    path = scratch_path(spark, "intervals")
    dealt.groupBy("block").applyInArrow(_intervals(k), INTERVALS).write.parquet(path)
    intervals = spark.read.parquet(path)
    inside = intervals.select("id", "pos", "k").join(_counts_inside(spark, intervals), "id")
    near = inside.groupBy("pos").agg(
        F.count("*").alias("n"), F.avg(F.expr(digamma("k"))).alias("k_part"), F.avg(F.expr(digamma("m"))).alias("m_part"))
    classes = numbered.groupBy("pos", "y").agg(F.count("*").alias("c")).filter("c > 1")
    sizes = classes.groupBy("pos").agg((F.sum(F.expr(f"c * {digamma('c')}")) / F.sum("c")).alias("c_part"))
    scores = near.join(sizes, "pos").select("pos", F.expr(f"{digamma('n')} + k_part - c_part - m_part").alias("part"))
    listed = local_table(spark, list(enumerate(columns)), "pos int, feature string")
    return _ranked(listed.join(scores, "pos", "left").selectExpr(
        "'mutual_info' AS method", "feature", "coalesce(greatest(part, 0D), 0D) AS score"))
