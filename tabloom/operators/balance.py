"""Class balancing by exact quotas; copies and picks need no ranking of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.keys import class_of, row_hash
from tabloom.functions.text import quoted
from tabloom.operators.profile import class_distribution
from tabloom.operators.select import attach, class_counts, heavy_classes, pick_lowest, repeat_rows


def oversample(
    df: DataFrame, label: str, key: Sequence[str], seed: int = 42, copy_col: str = "copy"
) -> DataFrame:
    """Repeat rows of smaller classes until every class is as large as the largest.

    Every original row is kept. A class of n rows is repeated ``most div n`` times
    and its ``most mod n`` rows lowest in the seeded order once more; ``copy_col``
    numbers the copies from 1.
    """
    counts, small = class_counts(df, label)
    most, least = counts.agg(F.max("n"), F.min("n")).first()
    if most is None:
        return df.withColumn(copy_col, F.lit(1).cast("long"))
    quotas = counts.withColumn("q", F.lit(most) % F.col("n"))
    picked = pick_lowest(df, key, quotas, label, small=small, seed=seed, into="_extra")
    whole = counts.select("_class", F.expr(f"{most} DIV n").alias("_whole"))
    classed = picked.withColumn("_class", class_of(label))
    copies = attach(classed, whole, small, heavy=heavy_classes(counts, small)).withColumn(
        "_times", F.col("_whole") + F.col("_extra").cast("long")
    )
    repeated = repeat_rows(copies, "_times", copy_col, most // least + 1)
    return repeated.select(*[quoted(c) for c in df.columns], copy_col)


def undersample(df: DataFrame, label: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Keep, per class, as many rows as the smallest class has; no row twice."""
    counts, small = class_counts(df, label)
    least = counts.agg(F.min("n")).first()[0]
    if least is None:
        return df
    quotas = counts.withColumn("q", F.lit(least))
    picked = pick_lowest(df, key, quotas, label, small=small, seed=seed, into="_keep")
    return picked.filter("_keep").drop("_keep")


def balance(df: DataFrame, strategy: str, label: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Apply ``oversample``, ``undersample`` or ``none``.

    Balance the training side only, after splitting: copies made before a split
    would reach both sides.
    """
    if strategy == "oversample":
        return oversample(df, label, key, seed)
    if strategy == "undersample":
        return undersample(df, label, key, seed)
    if strategy == "none":
        return df
    raise ValueError(f"unknown balance strategy {strategy!r}")


def shuffle(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in the seeded order, over the whole table.

    One range exchange. Content and input position break ties, so the copies of a
    hot key are spread over several ranges instead of filling one.
    """
    order = ["_h", *key, "_body", "_pos"]
    return (
        df.withColumns(
            {
                "_h": row_hash(key, seed),
                "_body": F.xxhash64(*[quoted(c) for c in df.columns]),
                "_pos": F.monotonically_increasing_id(),
            }
        )
        .orderBy(*order)
        .drop("_h", "_body", "_pos")
    )


def balance_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Count and percent per class before and after balancing."""
    old = class_distribution(before, label).select(
        "label", F.col("n").alias("n_before"), F.col("pct").alias("pct_before")
    )
    new = class_distribution(after, label).select(
        "label", F.col("n").alias("n_after"), F.col("pct").alias("pct_after")
    )
    return old.join(new, "label", "full").fillna(0)
