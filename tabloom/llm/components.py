"""Connected components of a link table by alternating star contractions.

Every round hangs the neighbours of each node below the smallest node it knows:
first those above the node (large star), then those below it (small star). Both
are a grouped minimum and a join on the node, so a node with very many links is
pre-aggregated on the map side and its join partition can be split by the
adaptive skew join. Each round ends in a table in the shared folder; the rounds
grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stage


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)") % F.lit(1_000_000_007).cast("decimal(38,0)"))
    ).first()
    return row[0], int(row[1] or 0)


def _pairs(a, b) -> list:
    return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]


def _hang(near: DataFrame, least) -> DataFrame:
    """Each (node, other) with ``top``, the smallest node that ``node`` knows."""
    tops = near.groupBy("node").agg(F.min("other").alias("top")).select("node", least.alias("top"))
    return near.join(tops, "node")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link: root is the smallest node
    reachable, itself included. Null ends and loops are dropped; repeated links do
    no harm; an empty table gives an empty result."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stage(edges.select(*_pairs(x, y)).filter("hi > lo").distinct(), "links")
    seen = _mark(now)
    while seen[0]:
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionAll(
            now.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        )
        large = _hang(both, F.least("node", "top")).filter("other > node")
        large = large.select(F.col("other").alias("node"), F.col("top").alias("other")).distinct()
        small = _hang(large, F.col("top"))
        moved = small.select(F.col("other").alias("x"), "top").unionAll(small.select(F.col("node").alias("x"), "top"))
        now = stage(moved.filter("x > top").select(F.col("x").alias("hi"), F.col("top").alias("lo")).distinct(), "links")
        before, seen = seen, _mark(now)
        if before == seen:
            break
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
