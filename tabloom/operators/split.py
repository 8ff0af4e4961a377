"""Train/test splitting: exact sizes, repeatable, no shuffle of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.keys import class_of
from tabloom.operators.positions import positions
from tabloom.operators.profile import with_totals
from tabloom.operators.select import RESOLVE_ROWS, class_counts, pick_lowest
from tabloom.session import local_table, settle

TRAIN, TEST = "train", "test"
DEFAULT_RATIO = 0.2
HOLDOUT_RATIO = 0.05


class StratificationError(ValueError):
    """The classes are too small for a stratified split."""


def split_sizes(n: int, ratio: float) -> tuple[int, int]:
    """``(n_train, n_test)`` with the test side rounded up."""
    if not 0 < ratio < 1:
        raise ValueError(f"ratio must lie between 0 and 1, not {ratio}")
    n_test = math.ceil(n * ratio)
    if n - n_test <= 0:
        raise ValueError(f"{n} rows with ratio {ratio} leave no training rows")
    return n - n_test, n_test


def stratified_quotas(counts: DataFrame, n_train: int, total: int, small: bool = True) -> DataFrame:
    """``(_class, n, q)`` with q test rows per class.

    Training rows are shared out by whole parts first, then by largest remainder
    (ties by class name); integers throughout. A class table that is not ``small`` is ordered by ranges.
    """
    share = (F.col("n").cast("decimal(38,0)") * F.lit(n_train)).alias("share")
    parts = counts.select("_class", "n", share).select(
        "_class",
        "n",
        F.expr(f"CAST(share DIV {total} AS BIGINT)").alias("floor"),
        (F.col("share") % F.lit(total)).alias("rest"),
    )
    missing = n_train - parts.agg(F.sum("floor")).first()[0]
    order = [F.desc("rest"), F.asc("_class")]
    if small:
        placed = parts.withColumn("_at", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        placed = positions(parts, order, "_at")
    extra = F.when(F.col("_at") < missing, 1).otherwise(0)
    return placed.select("_class", "n", (F.col("n") - F.col("floor") - extra).alias("q"))


def _apply(df, key, quotas, label, seed, small, resolve_rows):
    picked = pick_lowest(
        df, key, quotas, label, small=small, seed=seed, into="_test", resolve_rows=resolve_rows
    )
    side = F.when(F.col("_test"), F.lit(TEST)).otherwise(F.lit(TRAIN))
    return picked.withColumn("split", side).drop("_test")


def stratified_split(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    ratio: float = DEFAULT_RATIO,
    seed: int = 42,
    *,
    resolve_rows: int = RESOLVE_ROWS,
) -> DataFrame:
    """Adds ``split`` (train or test), keeping the class shares.

    Raises ``StratificationError`` when a class has fewer than two rows or a side
    has fewer rows than there are classes.
    """
    counts, small = class_counts(df, label)
    n_classes, total, least = counts.agg(F.count("*"), F.sum("n"), F.min("n")).first()
    n_train, n_test = split_sizes(total or 0, ratio)
    if least < 2 or n_test < n_classes or n_train < n_classes:
        raise StratificationError(
            f"{n_classes} classes, smallest {least}, train {n_train}, test {n_test}"
        )
    quotas = stratified_quotas(counts, n_train, total, small)
    if small:
        quotas, small = settle(quotas)
    return _apply(df, key, quotas, label, seed, small, resolve_rows)


def random_split(
    df: DataFrame,
    key: Sequence[str],
    ratio: float = DEFAULT_RATIO,
    seed: int = 42,
    *,
    resolve_rows: int = RESOLVE_ROWS,
) -> DataFrame:
    """Adds ``split`` with an exact number of test rows, classes ignored."""
    total = df.count()
    _, n_test = split_sizes(total, ratio)
    quotas = local_table(df.sparkSession, [("", total, n_test)], "_class string, n long, q long")
    return _apply(df, key, quotas, None, seed, True, resolve_rows)


def split(
    df: DataFrame,
    key: Sequence[str],
    label: str | None = None,
    ratio: float = DEFAULT_RATIO,
    seed: int = 42,
    task: str = "multiclass",
) -> DataFrame:
    """Stratified for classification, random for regression or tiny classes."""
    if task != "regression" and label is not None:
        try:
            return stratified_split(df, label, key, ratio, seed)
        except StratificationError:
            pass
    return random_split(df, key, ratio, seed)


def assign_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Two given tables as one: nothing is split."""
    return train.withColumn("split", F.lit(TRAIN)).unionByName(
        test.withColumn("split", F.lit(TEST)), allowMissingColumns=True
    )


def split_report(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per split and class."""
    counts = df.groupBy("split", class_of(label).alias("label")).agg(F.count("*").alias("n"))
    return with_totals(counts, "split").withColumn("pct", F.try_divide(F.col("n") * F.lit(100.0), F.col("total"))).drop("total")


def holdout(
    train: DataFrame,
    key: Sequence[str],
    label: str | None = None,
    ratio: float = HOLDOUT_RATIO,
    seed: int = 42,
) -> DataFrame:
    """Sets a validation share of the training rows aside: split is train or validation."""
    marked = split(train.drop("split"), key, label, ratio, seed)
    return marked.withColumn(
        "split", F.when(F.col("split") == TEST, "validation").otherwise(F.col("split"))
    )
