"""Table profiling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.keys import class_of
from tabloom.functions.text import plain_sql, quoted
from tabloom.operators.quantiles import quantiles
from tabloom.session import local_table, settle

# Limits of the profile.
TOP_VALUES = 10
HEAD_ROWS = 5
TEXT_DISTINCT_LIMIT = 20
ANY_DISTINCT_LIMIT = 10

# Sketch bound below which a column may have few distinct values. The sketch errs
# by about 1 %, so every column with at most 20 distinct values lies far below it.
FEW_DISTINCT_SKETCH = 100
SKETCH_LG_K = 14
SKETCH_RSD = 0.01
# Size of a quantile sketch, and the rank error that it keeps with 99 % confidence, as a share of the values.
SKETCH_K = 4096
SKETCH_RANK_ERROR = 0.002


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers, booleans excluded."""
    return isinstance(dtype, T.NumericType)


def is_text_like(dtype: T.DataType) -> bool:
    """Everything neither numeric nor boolean: strings, dates, timestamps."""
    return not isinstance(dtype, (T.NumericType, T.BooleanType))


def _family(dtype: T.DataType) -> str:
    """Type in which values of a column are counted."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "BIGINT"
    return "DOUBLE" if isinstance(dtype, T.DoubleType) else "STRING"


def _cell(field: T.StructField) -> str:
    """Value as text, in SQL; NaN is missing and -0.0 equals 0.0."""
    c = quoted(field.name)
    if isinstance(field.dataType, T.FloatType):
        return f"CAST(CASE WHEN NOT isnan({c}) THEN {c} + 0F END AS STRING)"
    if isinstance(field.dataType, T.DoubleType):
        return f"CAST({plain_sql(field.name)} AS STRING)"
    return f"CAST({c} AS STRING)"


def cells_as_text(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The values of columns as text, in SQL, as value counts show them."""
    double = lambda f: f"CAST({plain_sql(f.name)} + 0D AS STRING)"
    return [double(f) if isinstance(f.dataType, T.DoubleType) else _cell(f) for f in (df.schema[c] for c in columns)]


def _fields(df: DataFrame, columns: Iterable[str] | None) -> list[T.StructField]:
    names = df.columns if columns is None else list(columns)
    return [df.schema[n] for n in names]


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def value_table(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``(column, value, n)`` with a null bucket.

    Distinct counts, missing counts and value counts all follow from it. Whole
    numbers, doubles and texts are counted apart, each in its own type: every
    column is read and expanded once, the shuffle carries positions and plain
    values, and only distinct values are turned into text. Partial counts collapse
    frequent values before the shuffle.
    """
    families: dict[str, list[T.StructField]] = {}
    for f in _fields(df, columns):
        families.setdefault(_family(f.dataType), []).append(f)
    return reduce(DataFrame.unionByName, [_count_values(df, kind, fs) for kind, fs in families.items()])


def _count_values(df: DataFrame, family: str, fields: Sequence[T.StructField]) -> DataFrame:
    cells = ", ".join(_cell(f) if family == "STRING" else f"CAST({quoted(f.name)} AS {family})" for f in fields)
    tall = df.selectExpr(f"posexplode(array({cells})) AS (pos, value)")
    if family == "DOUBLE":
        tall = tall.selectExpr("pos", "nanvl(value, CAST(NULL AS DOUBLE)) AS value")
    # Grouping folds -0.0 into 0.0.
    counts = tall.groupBy("pos", "value").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(f.name) for f in fields])
    return counts.select(F.get(names, F.col("pos")).alias("column"), F.col("value").cast("string").alias("value"), "n")


def _position_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    schema = {f.name: f.dataType for f in df.schema}
    rows = [
        (i, n, schema[n].simpleString(), is_numeric(schema[n]), is_text_like(schema[n]))
        for i, n in enumerate(names)
    ]
    return local_table(
        df.sparkSession, rows, "position int, column string, dtype string, numeric boolean, text_like boolean"
    )


def profile_from_values(df: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Column profile derived from a value table."""
    counts = values.groupBy("column").agg(
        F.count("value").alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.sum("n").alias("n_rows"),
    )
    # An empty table still has its columns; the position table has one row per column.
    return (
        F.broadcast(_position_table(df, names))
        .join(counts, "column", "left")
        .fillna(0, ["n_unique", "n_missing", "n_rows"])
        .select("position", "column", "dtype", "numeric", "text_like", "n_unique", "n_missing", "n_rows")
    )


def column_profile(df: DataFrame, max_cols: int | None = None, approximate: bool = False) -> DataFrame:
    """Type, distinct non-missing values and missing values per column.

    All columns, or the first ``max_cols``; ``n_more`` tells how many follow. The
    approximate form needs no expand and no shuffle of values.
    """
    names = df.columns[:max_cols]
    n_more = len(df.columns) - len(names)
    if approximate:
        table = sketch_profile(df, names)
    else:
        table = profile_from_values(df, value_table(df, names), names)
    return table.withColumn("n_more", F.lit(n_more))


def sketch_profile(df: DataFrame, columns: Sequence[str], lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Column profile with sketched distinct counts: one pass, nothing expanded."""
    fields = _fields(df, columns)
    stats = ", ".join(
        f"struct({i} AS position, coalesce(hll_sketch_estimate(hll_sketch_agg({_cell(f)}, {lg_k})), 0) AS n_unique, "
        f"count(*) - count({_cell(f)}) AS n_missing, count(*) AS n_rows)"
        for i, f in enumerate(fields)
    )
    counts = df.agg(F.expr(f"array({stats})").alias("stats")).select(F.inline("stats"))
    return (
        F.broadcast(_position_table(df, [f.name for f in fields]))
        .join(counts, "position")
        .select("position", "column", "dtype", "numeric", "text_like", "n_unique", "n_missing", "n_rows")
    )


def numeric_columns(df: DataFrame, max_cols: int | None = None) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)][:max_cols]


def numeric_summary(df: DataFrame, max_cols: int | None = None, digits: int = 4, approximate: bool = False) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, quartiles and maximum.

    One row per numeric column (all, or the first ``max_cols``); moments in one pass,
    quartiles exact by interpolation. ``approximate`` reads quartiles off mergeable sketches in the same pass over all columns: values of the
    column whose rank is within ``SKETCH_RANK_ERROR`` of the wanted one, as a share of its values.
    """
    names = numeric_columns(df, max_cols)
    spark = df.sparkSession
    schema = (
        "position int, column string, count long, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double"
    )
    if not names:
        return local_table(spark, [], schema)
    sketch = f", kll_sketch_agg_double({{v}}, {SKETCH_K}) AS sketch" if approximate else ""
    moments = df.agg(*[
        F.expr(
            f"struct(count({v}) AS count, avg({v}) AS mean, stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max{sketch.format(v=v)})"
        ).alias(f"m{i}")
        for i, v in enumerate(map(plain_sql, names))
    ])
    if approximate:
        # A column without values has an empty sketch.
        read = "IF(m{i}.count > 0, kll_sketch_get_quantile_double(m{i}.sketch, array(0.25D, 0.5D, 0.75D)), array(NULL, NULL, NULL))"
        found = moments.selectExpr(*[
            f"struct(m{i}.count, m{i}.mean, m{i}.std, m{i}.min, m{i}.max, {read.format(i=i)} AS quartiles) AS m{i}" for i in range(len(names))
        ]).first()
        quartiles = {n: found[i]["quartiles"] for i, n in enumerate(names)}
    else:
        found = moments.first()
        quartiles = quantiles(df, names, [0.25, 0.5, 0.75], {n: found[i]["count"] for i, n in enumerate(names)})
    rows = [
        (i, n, m["count"], m["mean"], m["std"], m["min"], *(quartiles[n] or [None] * 3), m["max"])
        for i, (n, m) in enumerate(zip(names, found))
    ]
    table = local_table(spark, rows, schema)
    rounded = {c: F.round(c, digits) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")}
    return table.withColumns(rounded)


def few_distinct_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that can have few distinct values, decided by one sketch pass."""
    sketch = sketch_profile(df, list(columns) if columns is not None else df.columns)
    kept = sketch.filter(F.col("n_unique") <= FEW_DISTINCT_SKETCH).select("column", "position")
    return [r["column"] for r in sorted(kept.collect(), key=lambda r: r["position"])]


def is_categorical() -> Column:
    """Rule on a column profile: few distinct values (more are allowed for text)."""
    few_text = F.col("text_like") & (F.col("n_unique") <= TEXT_DISTINCT_LIMIT)
    return few_text | (F.col("n_unique") <= ANY_DISTINCT_LIMIT)


def categorical_columns(df: DataFrame) -> DataFrame:
    """Low-cardinality columns with their exact distinct counts.

    The sketch rules high-cardinality columns out first, so the exact count groups
    by a bounded number of values.
    """
    names = few_distinct_candidates(df)
    position = {n: i for i, n in enumerate(df.columns)}
    if not names:
        return local_table(df.sparkSession, [], "position int, column string, dtype string, n_unique long")
    exact = profile_from_values(df, value_table(df, names), names).filter(is_categorical())
    original = F.create_map(*[F.lit(x) for n in names for x in (n, position[n])])
    return exact.select(
        F.element_at(original, F.col("column")).alias("position"), "column", "dtype", "n_unique"
    )


def top_values(values: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values per column of a value table.

    The rank filter is pushed below the exchange (a limit per group), so a
    column with many values sends at most k rows per task.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return values.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def value_counts(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES, max_cols: int | None = None
) -> DataFrame:
    """Top values per column, the missing bucket included.

    Without ``columns``: all low-cardinality columns, or the first ``max_cols``.
    """
    if columns is None:
        found = categorical_columns(df).collect()
        columns = [r["column"] for r in sorted(found, key=lambda r: r["position"])][:max_cols]
    if not columns:
        return local_table(df.sparkSession, [], "column string, value string, n long, rank int")
    return top_values(value_table(df, columns), k)


def head_sample(
    df: DataFrame, order_by: Sequence[str], n: int = HEAD_ROWS, max_cols: int | None = None
) -> DataFrame:
    """First rows in key order, all or the first ``max_cols`` columns (top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n).select(*[f"`{c}`" for c in df.columns[:max_cols]])


def profile(
    df: DataFrame,
    order_by: Sequence[str],
    approximate: bool = False,
    max_cols: int | None = None,
    max_numeric: int | None = None,
    max_categorical: int | None = None,
) -> dict[str, DataFrame]:
    """All profile tables, over all columns unless a limit is given.

    ``max_cols`` limits the column table and the head, ``max_numeric`` the numeric
    summary, ``max_categorical`` the value counts.

    The column table is settled, since the categorical rule and the choice of value
    counts read it; value counts then touch low-cardinality columns only. The
    approximate form sketches distinct counts and quartiles and shuffles no values for them.
    """
    exact = column_profile(df, None, approximate).drop("n_more")
    described, _ = settle(exact)
    categorical = categorical_columns(df) if approximate else described.filter(is_categorical())
    chosen = sorted(categorical.collect(), key=lambda r: r["position"])[:max_categorical]
    names = df.columns[:max_cols]
    shown = described.filter(F.col("position") < len(names)).withColumn("n_more", F.lit(len(df.columns) - len(names)))
    return {
        "shape": table_shape(df),
        "columns": shown,
        "numeric": numeric_summary(df, max_numeric, approximate=approximate),
        "categorical": categorical,
        "value_counts": value_counts(df, [r["column"] for r in chosen]),
        "head": head_sample(df, order_by, max_cols=max_cols),
    }


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per class; a missing label is the class ''.

    The total is a scalar subquery over the same counts, so no class table meets in
    one task.
    """
    counts = df.groupBy(class_of(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.try_divide(F.col("n") * F.lit(100.0), total))


def with_totals(counts: DataFrame, group: str) -> DataFrame:
    """Class counts with the ``total`` of their group.

    Totals are summed apart, per task first, and met by a join that Spark turns into a broadcast when they are few; a
    window would bring all classes of a group into one task.
    """
    totals = counts.groupBy(F.col(quoted(group)).alias("_group")).agg(F.sum("n").alias("total"))
    met = counts.join(totals, F.col(quoted(group)).eqNullSafe(F.col("_group")))
    return met.select(*[quoted(c) for c in counts.columns], "total")


def quality_notes(df: DataFrame, target: str) -> DataFrame:
    """Missing share per column and the imbalance ratio of the target.

    ``(note, column, value)``; the ratio is largest over smallest class.
    """
    missing = ", ".join(f"try_divide(count(*) - count({_cell(f)}), count(*))" for f in df.schema)
    names = F.array(*[F.lit(c) for c in df.columns])
    shares = df.agg(F.expr(f"array({missing})").alias("shares")).select(
        F.lit("missing_share").alias("note"), F.posexplode("shares").alias("pos", "value")
    ).select("note", F.get(names, F.col("pos")).alias("column"), "value")
    counts = df.groupBy(class_of(target).alias("c")).agg(F.count("*").alias("n"))
    ratio = counts.agg(
        F.lit("imbalance_ratio").alias("note"),
        F.lit(target).alias("column"),
        F.try_divide(F.max("n").cast("double"), F.min("n")).alias("value"),
    )
    return shares.unionByName(ratio)
