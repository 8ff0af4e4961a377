"""Exact, repeatable selection of q rows per class without ranking the table.

Rows are ordered inside their class by ``md5(seed|key)``. Instead of numbering
every row, the jobs here look for the one hash per class at which the quota is
reached; picking is then a narrow comparison against that hash, so the rows
themselves are never shuffled.

1. While a class has more candidates than ``RESOLVE_ROWS`` (or all classes together
   more than that per shuffle partition), count them by the next
   three hex digits and keep only the bucket in which the quota is crossed. Each
   round reads key and class columns and divides the candidates by 4096.
2. Count the remaining candidates by hash (copies of one key collapse before the
   shuffle) and take a running sum per class.
3. When copies of one key straddle the quota, order those copies by their whole
   content; copies equal in every column are interchangeable, so they are counted
   and written out again as picked and unpicked.

Where there are too many classes to broadcast, rows have to meet their class in a
shuffle anyway. Then the rows are shuffled by class once and numbered there; only
the few classes that hold many rows each go the way above.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.keys import class_of, content_hash, row_hash
from tabloom.functions.text import quoted
from tabloom.session import settle, settle_stored

HEX_STEP = 3
HASH_DIGITS = 32
RESOLVE_ROWS = 100_000
# A class with more than one row in so many is heavy.
HEAVY_SHARES = 1_000
# Rows repeated more often than this are spread over the cluster first.
NARROW_COPIES = 16


def class_counts(df: DataFrame, label: str | None) -> tuple[DataFrame, bool]:
    """``(_class, n)`` per class, settled; a second value tells whether it is small."""
    return settle_stored(df.groupBy(class_of(label).alias("_class")).agg(F.count("*").alias("n")))


def heavy_classes(counts: DataFrame, small: bool) -> DataFrame | None:
    """Of a class table too large to broadcast, the classes with more than 1 / ``HEAVY_SHARES`` of all rows: ``HEAVY_SHARES``
    classes at most. None if there is none, or if all classes may be broadcast."""
    if small:
        return None
    total = counts.agg(F.sum("n")).first()[0]
    names = counts.filter(F.col("n") * HEAVY_SHARES > F.lit(total)).select("_class")
    table, bounded = settle(names)
    return table if bounded and not table.isEmpty() else None


def attach(df: DataFrame, table: DataFrame, small: bool, how: str = "left", heavy: DataFrame | None = None) -> DataFrame:
    """Join a per-class table on ``_class``.

    A small table is broadcast. Otherwise the rows of ``heavy`` classes meet a broadcast of just these classes, so they
    stay where they are and no class fills a task, and the others are joined by shuffle.
    """
    if small:
        return df.join(F.broadcast(table), "_class", how)
    if heavy is None:
        return df.join(table, "_class", how)
    few = F.broadcast(heavy)
    staying = df.join(few, "_class", "left_semi").join(F.broadcast(table.join(few, "_class", "left_semi")), "_class", how)
    moving = df.join(few, "_class", "left_anti").join(table.join(few, "_class", "left_anti"), "_class", how)
    return staying.unionByName(moving)


def repeat_rows(df: DataFrame, times: str, index: str, most: int) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``index``.

    ``most`` is the largest value of ``times``. Few copies are made in place. Rows
    with many copies go out as blocks of copies dealt round-robin to all tasks, so
    neither a rare class nor a single hot row fills one task; the other rows, the
    bulk of the table, still do not move.
    """
    count = F.col(times).cast("long")
    one = F.lit(1).cast("long")
    few = df.filter((count > 0) & (count <= NARROW_COPIES)).withColumn(index, F.explode(F.sequence(one, count)))
    if most <= NARROW_COPIES:
        return few
    block = max(NARROW_COPIES, math.isqrt(most))
    last_block = F.floor((count - 1) / block)
    blocks = df.filter(count > NARROW_COPIES).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block))
    )
    first = F.col("_block") * block + 1
    last = F.least(count, (F.col("_block") + 1) * block)
    many = blocks.repartition(_partitions(df)).withColumn(index, F.explode(F.sequence(first, last)))
    return few.unionByName(many.drop("_block"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _crossing(counts: DataFrame, by: str, need: str) -> DataFrame:
    """The row of each class in whose count the needed position falls.

    Adds ``_before`` (candidates ahead of it). Counts per class are bounded: at most
    4096 buckets, or ``RESOLVE_ROWS`` hashes.
    """
    run = Window.partitionBy("_class").orderBy(by)
    upto = F.sum("n").over(run)
    return (
        counts.withColumn("_upto", upto)
        .filter((F.col("_upto") >= F.col(need)) & (F.col("_upto") - F.col("n") < F.col(need)))
        .withColumn("_before", F.col("_upto") - F.col("n"))
        .drop("_upto")
    )


def _cut_hashes(slim: DataFrame, quotas: DataFrame, small: bool, resolve_rows: int) -> tuple[DataFrame, bool]:
    """``(_class, _cut, _take, _tied)``: hash at the quota, rows to take at it, rows on it."""
    state = quotas.select("_class", F.lit("").alias("_prefix"), F.col("q").alias("_need"), F.col("n").alias("_left"), F.lit(False).alias("_single"))
    digits = 0
    while digits + HEX_STEP <= HASH_DIGITS:
        # Copies of one key cannot be told apart by more digits: such a bucket needs no further round.
        most, together = state.filter("NOT _single").agg(F.max("_left"), F.sum("_left")).first()
        if most is None or (most <= resolve_rows and together <= resolve_rows * _partitions(slim)):
            break
        digits += HEX_STEP
        inside = _inside(slim, state, small)
        buckets = inside.groupBy("_class", "_need", F.substring("_h", 1, digits).alias("_bucket")).agg(
            F.count("*").alias("n"), F.min("_h").alias("_least"), F.max("_h").alias("_most")
        )
        narrowed = _crossing(buckets, "_bucket", "_need").select(
            "_class",
            F.col("_bucket").alias("_prefix"),
            (F.col("_need") - F.col("_before")).alias("_need"),
            F.col("n").alias("_left"),
            (F.col("_least") == F.col("_most")).alias("_single"),
        )
        state, small = settle(narrowed)

    hashes = _inside(slim, state, small).groupBy("_class", "_need", "_h").agg(F.count("*").alias("n"))
    cuts = _crossing(hashes, "_h", "_need").select(
        "_class",
        F.col("_h").alias("_cut"),
        (F.col("_need") - F.col("_before")).alias("_take"),
        F.col("n").alias("_tied"),
    )
    return settle(cuts)


def _inside(slim: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    joined = attach(slim, state, small, "inner")
    return joined.filter(F.startswith("_h", "_prefix"))


def pick_lowest(
    df: DataFrame,
    key: Sequence[str],
    quotas: DataFrame,
    label: str | None = None,
    *,
    small: bool = True,
    seed: int = 42,
    into: str = "picked",
    resolve_rows: int = RESOLVE_ROWS,
) -> DataFrame:
    """Flag, in every class, the ``q`` rows lowest in the seeded order.

    ``quotas`` has one row ``(_class, n, q)`` per class with ``n`` rows in the
    table; ``small`` tells whether it may be broadcast. No row is lost: the result
    is ``df`` plus the boolean column ``into``.
    """
    classed = df.withColumn("_class", class_of(label))
    if small:
        return _pick_by_cuts(df.columns, classed, key, quotas, True, seed, into, resolve_rows)
    heavy = heavy_classes(quotas, small)
    if heavy is None:
        most, total = quotas.agg(F.max("n"), F.sum("n")).first()
        # Heavy classes whose names are too long to broadcast must not fill a task either.
        if most is not None and most * HEAVY_SHARES > total:
            return _pick_by_cuts(df.columns, classed, key, quotas, False, seed, into, resolve_rows)
        return _pick_by_number(df, label, key, quotas, seed, into)
    few = F.broadcast(heavy)
    staying, _ = settle(quotas.join(few, "_class", "left_semi").select("_class", "n", "q"))
    by_cuts = _pick_by_cuts(df.columns, classed.join(few, "_class", "left_semi"), key, staying, True, seed, into, resolve_rows)
    moving = classed.join(few, "_class", "left_anti").drop("_class")
    return by_cuts.unionByName(_pick_by_number(moving, label, key, quotas.join(few, "_class", "left_anti"), seed, into))


def _pick_by_number(df: DataFrame, label: str | None, key: Sequence[str], quotas: DataFrame, seed: int, into: str) -> DataFrame:
    """Rows numbered in their class, for classes of which none is heavy: one shuffle of the rows, classes and hashes made after it.

    The join needs no further sort: the rows lie in the order of their classes.
    """
    order = Window.partitionBy("_class").orderBy(F.unhex(row_hash(key, seed)), F.unhex(content_hash(df.columns, seed)))
    dealt = df.repartition(class_of(label)).withColumn("_class", class_of(label))
    met = dealt.withColumn("_number", F.row_number().over(order)).join(quotas.select("_class", "q"), "_class", "left")
    return met.select(*[quoted(c) for c in df.columns], (F.col("_number") <= F.col("q")).alias(into))


def _pick_by_cuts(
    names: Sequence[str], classed: DataFrame, key: Sequence[str], quotas: DataFrame, small: bool, seed: int, into: str, resolve_rows: int
) -> DataFrame:
    """Rows compared with the hash at which the quota of their class is reached."""
    columns = [quoted(c) for c in names]
    work = classed.withColumn("_h", row_hash(key, seed))
    cuts, cuts_small = _cut_hashes(work.select("_class", "_h"), quotas.filter("q > 0 AND q < n"), small, resolve_rows)
    rules = quotas.join(cuts, "_class", "left").select("_class", "n", "q", "_cut", "_take", "_tied")
    rules, rules_small = settle(rules)
    joined = attach(work, rules, rules_small)
    tie_taken = F.col("_take") == F.col("_tied")
    basic = (
        F.when(F.col("q") >= F.col("n"), True)
        .when(F.col("q") <= 0, False)
        .otherwise((F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & tie_taken))
    )
    open_ties = cuts.filter("_take < _tied")
    if open_ties.isEmpty():
        return joined.select(*columns, basic.alias(into))

    # Copies of one key straddle a quota: order them by their content.
    tie_quotas = open_ties.select("_class", F.col("_tied").alias("n"), F.col("_take").alias("q"))
    same_key = F.coalesce((F.col("_h") == F.col("_cut")) & ~tie_taken, F.lit(False))
    tied = (
        joined.filter(same_key)
        .withColumn("_h", content_hash(names, seed))
        .select("_class", "_h")
    )
    inner, _ = _cut_hashes(tied, tie_quotas, cuts_small, resolve_rows)
    inner = inner.select(
        "_class", F.col("_cut").alias("_cut2"), F.col("_take").alias("_take2"), F.col("_tied").alias("_tied2")
    )
    most = inner.agg(F.max("_tied2")).first()[0]
    second = attach(joined.withColumn("_same", same_key), inner, cuts_small).withColumn(
        "_h2", F.when(F.col("_same"), content_hash(names, seed))
    )
    split_copies = F.coalesce(
        F.col("_same") & (F.col("_h2") == F.col("_cut2")) & (F.col("_take2") < F.col("_tied2")), F.lit(False)
    )
    refined = F.when(
        F.col("_same"),
        (F.col("_h2") < F.col("_cut2"))
        | ((F.col("_h2") == F.col("_cut2")) & (F.col("_take2") == F.col("_tied2"))),
    ).otherwise(basic)
    plain = second.filter(~split_copies).select(*columns, refined.alias(into))
    # Identical rows: one representative per class (map-side first()), written out
    # once per copy; which physical copy is picked makes no difference.
    copies = (
        second.filter(split_copies)
        .groupBy("_class")
        .agg(F.first(F.struct(*columns)).alias("_row"), F.first("_take2").alias("_take2"), F.first("_tied2").alias("_tied2"))
    )
    rebuilt = repeat_rows(copies, "_tied2", "_copy", most).select(
        "_row.*", (F.col("_copy") <= F.col("_take2")).alias(into)
    )
    return plain.unionByName(rebuilt)
