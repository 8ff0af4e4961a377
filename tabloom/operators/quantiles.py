"""Exact quantiles of many columns without holding a column in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the
wanted order statistics are located first: approximate quantiles give cut values,
one count per (column, piece) tells exactly which piece holds each wanted rank, and
only that piece is looked at again. Approximation errors cost another round at
most; they never change the result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import quoted
from tabloom.session import local_table

# Pieces with at most this many values are sorted directly.
RESOLVE_VALUES = 1_000_000
# Accuracy of the approximate distribution (memory of its sketch per column): the
# finer one for pieces above LARGE_PIECE, where it saves rounds.
LARGE_PIECE = 100_000_000
ACCURACY, LARGE_ACCURACY = 1000, 10_000
# Cut values lie on a grid this many times coarser than the accuracy.
GRID_FACTOR = 10


def long_values(df: DataFrame, columns: Sequence[str], *carried: str) -> DataFrame:
    """``(*carried, pos, v)`` for every non-missing value of the numeric columns.

    ``pos`` is the position of the column in ``columns``: a short key to shuffle.
    ``carried`` are SQL expressions kept beside each value.
    """
    cells = ", ".join(f"CAST({quoted(c)} AS DOUBLE)" for c in columns)
    # NaN is sorted out after the expand: one test in the code instead of one per column.
    return df.selectExpr(*carried, f"posexplode(array({cells})) AS (pos, v)").filter("v IS NOT NULL AND NOT isnan(v)")


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    counts: Mapping[str, int] | None = None,
    resolve_values: int = RESOLVE_VALUES,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column; None for columns without values."""
    if not columns:
        return {}
    values = long_values(df, columns)
    if counts is None:
        found = values.groupBy("pos").agg(F.count("*").alias("n")).collect()
        sizes = {r["pos"]: r["n"] for r in found}
    else:
        sizes = {i: counts.get(c, 0) for i, c in enumerate(columns)}
    wanted: dict[int, set[int]] = {}
    for pos, n in sizes.items():
        if n > 0:
            wanted[pos] = {int(f(p * (n - 1))) for p in probs for f in (math.floor, math.ceil)}
    found = _order_statistics(values, sizes, wanted, resolve_values)
    return {
        c: [_between(found, i, p * (sizes[i] - 1)) if i in wanted else None for p in probs]
        for i, c in enumerate(columns)
    }


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, columns, [0.5]).items()}


def _between(found: Mapping[tuple[int, int], float], column: int, position: float) -> float:
    low, high = found[column, math.floor(position)], found[column, math.ceil(position)]
    return low if low == high else low + (high - low) * (position - math.floor(position))


def _order_statistics(values, counts, wanted, resolve_values):
    """Value at each wanted 0-based rank: ``{(column position, rank): value}``."""
    spark = values.sparkSession
    # A piece: (column, low, high, values before it, values in it), bounds exclusive.
    pieces = [(c, None, None, 0, counts[c]) for c in wanted]
    found: dict[tuple[int, int], float] = {}
    while pieces:
        large = [p for p in pieces if p[4] > resolve_values]
        small = [p for p in pieces if p[4] <= resolve_values]
        if small:
            found.update(_read_off(spark, values, small, wanted))
        pieces = _narrow(spark, values, large, wanted, found) if large else []
    return found


def _ranks_in(piece, wanted) -> list[int]:
    column, _, _, before, n = piece
    return sorted(r for r in wanted[column] if before <= r < before + n)


def _inside(spark, values, pieces, extra_rows=None, extra_schema=""):
    """Values that lie in a piece, tagged with its number (a few rows per column)."""
    rows = [(i, p[0], p[1], p[2], *(extra_rows[i] if extra_rows else ())) for i, p in enumerate(pieces)]
    table = local_table(spark, rows, "piece int, pos int, low double, high double" + extra_schema)
    joined = values.join(F.broadcast(table), "pos")
    return joined.filter(
        (F.col("low").isNull() | (F.col("v") > F.col("low")))
        & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    )


def _read_off(spark, values, pieces, wanted):
    """Sort small pieces and read the wanted ranks."""
    ranks = [(i, r - p[3]) for i, p in enumerate(pieces) for r in _ranks_in(p, wanted)]
    distinct = _inside(spark, values, pieces).groupBy("piece", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("piece").orderBy("v"))
    hits = (
        distinct.withColumn("upto", upto)
        .join(F.broadcast(local_table(spark, ranks, "piece int, rank long")), "piece")
        .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .select("piece", "v", "rank")
    )
    return {
        (pieces[r["piece"]][0], r["rank"] + pieces[r["piece"]][3]): r["v"] for r in hits.collect()
    }


def _narrow(spark, values, pieces, wanted, found):
    """Cut large pieces around the wanted ranks; returns the pieces left to look at."""
    accuracy = LARGE_ACCURACY if max(p[4] for p in pieces) > LARGE_PIECE else ACCURACY
    steps_in_all = accuracy // GRID_FACTOR
    grid = [i / steps_in_all for i in range(steps_in_all + 1)]
    approx = _inside(spark, values, pieces).groupBy("piece").agg(
        F.percentile_approx("v", grid, accuracy).alias("grid")
    )
    cuts: dict[int, list[float]] = {}
    for row in approx.collect():
        piece = pieces[row["piece"]]
        steps = set()
        for rank in _ranks_in(piece, wanted):
            at = (rank - piece[3]) / piece[4] * steps_in_all
            steps |= {max(0, math.floor(at) - 1), min(steps_in_all, math.ceil(at) + 1)}
        cuts[row["piece"]] = sorted({row["grid"][s] for s in steps})

    # Cuts are padded with nulls to plain columns, which stay in generated code.
    width = max(map(len, cuts.values()))
    extra = [(*cuts[i], *[None] * (width - len(cuts[i]))) for i in range(len(pieces))]
    names = [f"c{k}" for k in range(width)]
    tagged = _inside(spark, values, pieces, extra, "".join(f", {n} double" for n in names))
    # Even codes lie between two cuts, odd codes on a cut.
    code = " + ".join(
        f"CAST(coalesce(v > {n}, false) AS INT) + CAST(coalesce(v >= {n}, false) AS INT)" for n in names
    )
    sizes = tagged.selectExpr("piece", f"{code} AS code").groupBy("piece", "code").agg(F.count("*").alias("n"))
    per_piece: dict[int, dict[int, int]] = {}
    for row in sizes.collect():
        per_piece.setdefault(row["piece"], {})[row["code"]] = row["n"]

    rest = []
    for i, piece in enumerate(pieces):
        column, low, high, before, _ = piece
        for code in sorted(per_piece.get(i, {})):
            n = per_piece[i][code]
            ranks = [r for r in wanted[column] if before <= r < before + n]
            if ranks and code % 2:
                found.update({(column, r): cuts[i][code // 2] for r in ranks})
            elif ranks:
                k = code // 2
                rest.append((column, cuts[i][k - 1] if k else low, cuts[i][k] if k < len(cuts[i]) else high, before, n))
            before += n
    return rest
