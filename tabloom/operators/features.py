"""Feature ranking: imputation, variance filter, three rankings, their mean rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import plain_sql, quoted
from tabloom.operators.columns import candidates, drop_missing_target
from tabloom.operators.profile import is_text_like
from tabloom.operators.quantiles import long_values, medians, quantiles
from tabloom.operators.positions import positions
from tabloom.operators.select import attach, heavy_classes
from tabloom.session import local_table, scratch_path, settle, settle_stored

# Gates and limits of the ensemble, defaults of its arguments.
HIGH_DIMENSION = 50
MAX_SELECTED = 100
VARIANCE_THRESHOLD = 0.01
METHODS = ("correlation", "mutual_info", "random_forest")

MI_BINS = 10
SCORE_DIGITS = 9


# Statistics of a feature over v (its value) and y (the target). corr() itself fails
# on a column without variance in ANSI mode.
VARIANCE = "var_pop(v)"
CORRELATION = (
    "abs(try_divide(covar_pop(v, y), stddev_pop(CASE WHEN y IS NOT NULL THEN v END) * stddev_pop(y)))"
)


def column_stats(
    df: DataFrame, columns: Sequence[str], stats: Sequence[str], y: str | None = None
) -> list[dict[str, float | None]]:
    """Statistics of many columns in one pass, one ``{column: value}`` per statistic.

    Each is an SQL aggregate over ``v`` and ``y``. It runs over (position, value)
    pairs: the plan does not grow with the columns and partial aggregates leave one
    row per column and task.
    """
    target = f"CAST({quoted(y)} AS DOUBLE) AS y" if y else "CAST(NULL AS DOUBLE) AS y"
    wanted = [F.expr(s).alias(f"s{i}") for i, s in enumerate(stats)]
    rows = long_values(df, columns, target).groupBy("pos").agg(*wanted).collect()
    return [{columns[r["pos"]]: r[f"s{i}"] for r in rows} for i in range(len(stats))]


def impute_median(
    df: DataFrame, columns: Sequence[str], known: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Missing values of the numeric columns replaced by the column median.

    ``known`` carries medians fitted elsewhere (the training table).
    """
    fitted = medians(df, columns) if known is None else known
    filled = {}
    for c in columns:
        value = fitted.get(c)
        default = "CAST(NULL AS DOUBLE)" if value is None else f"{value!r}D"
        filled[c] = f"coalesce({plain_sql(c)}, {default}) AS {quoted(c)}"
    return df.selectExpr(*[filled.get(c, quoted(c)) for c in df.columns])


def column_variances(df: DataFrame, columns: Sequence[str], threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """``(feature, variance, kept)`` with population variances."""
    found = column_stats(df, columns, [VARIANCE])[0]
    rows = [(c, found.get(c), found.get(c) is not None and found[c] > threshold) for c in columns]
    return local_table(df.sparkSession, rows, "feature string, variance double, kept boolean")


def variance_filter(
    df: DataFrame, columns: Sequence[str], threshold: float = VARIANCE_THRESHOLD
) -> list[str]:
    """Columns whose population variance exceeds the threshold, in order."""
    return _varied(column_stats(df, columns, [VARIANCE])[0], columns, threshold)


def _varied(variances: Mapping[str, float | None], columns: Sequence[str], threshold: float) -> list[str]:
    kept = [c for c in columns if variances.get(c) is not None and variances[c] > threshold]
    if not kept:
        raise ValueError(f"no feature has a variance above {threshold}")
    return kept


def encode_label(df: DataFrame, y: str, into: str = "y_code") -> DataFrame:
    """Classes as 0..k-1 in text order; a missing class has no code. Any number of classes: they are numbered by ranges."""
    text = F.col(quoted(y)).cast("string")
    classes = df.groupBy(text.alias("_class")).agg(F.count("*").alias("n")).filter("_class IS NOT NULL")
    counts, small = settle_stored(classes)
    if small:
        # At most SMALL_ROWS rows, held by the driver.
        codes = counts.withColumn(into, (F.row_number().over(Window.orderBy("_class")) - 1).cast("int"))
    else:
        codes = positions(counts, ["_class"], into).withColumn(into, F.col(into).cast("int"))
    joined = attach(df.withColumn("_class", text), codes.drop("n"), small, heavy=heavy_classes(counts, small))
    return joined.select(*[quoted(c) for c in df.columns], into)


def ranking(spark, method: str, scores: Mapping[str, float | None]) -> DataFrame:
    """``(method, feature, score, rank)``: 0-based rank by score, ties by name."""
    rows = [(method, f, float(s or 0.0)) for f, s in scores.items()]
    return _ranked(local_table(spark, rows, "method string, feature string, score double"))


def _ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("method").orderBy(F.desc("score"), "feature")
    return scores.withColumn("score", F.round("score", SCORE_DIGITS)).withColumn(
        "rank", F.row_number().over(order) - 1
    )


def rank_correlation(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Absolute Pearson correlation with the target; undefined counts as 0.

    A text-like target is encoded; a numeric one is used as it is.
    """
    coded, code = _coded(df, y)
    found = column_stats(coded, columns, [CORRELATION], code)[0]
    return ranking(df.sparkSession, "correlation", {c: found.get(c) for c in columns})


def _coded(df: DataFrame, y: str) -> tuple[DataFrame, str]:
    """The table with a numeric target: text is encoded, numbers are used as they are."""
    return (encode_label(df, y, "_y_code"), "_y_code") if is_text_like(df.schema[y].dataType) else (df, y)


def bin_sql(value: str, edges: Sequence[str]) -> str:
    """Equal-frequency bin of a value as SQL: how many edges lie below it."""
    return " + ".join(f"CAST({value} > {e} AS INT)" for e in edges)


def rank_mutual_info(
    df: DataFrame,
    columns: Sequence[str],
    y: str,
    task: str = "multiclass",
    bins: int = MI_BINS,
    counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """Mutual information (natural log) of equal-frequency bins with the target.

    Classes are compared as text; a regression target is binned like a feature.
    ``counts`` are the non-missing values per column, when known already.
    Counting is one shuffle of at most features x bins x classes groups; the
    entropies come from grouping sets over those counts.
    """
    probs = [i / bins for i in range(1, bins)]
    rows = drop_missing_target(df, y)
    if task == "regression":
        target = bin_sql(plain_sql(y), [f"{e!r}D" for e in quantiles(rows, [y], probs)[y] if e is not None] or ["0D"])
    else:
        target = f"CAST({quoted(y)} AS STRING)"
    edges = quantiles(rows, columns, probs, counts)
    names = [f"e{i}" for i in range(len(probs))]
    # One row per column: the size is known from the schema.
    limits = local_table(
        df.sparkSession, [(i, *edges[c]) for i, c in enumerate(columns)],
        "pos int, " + ", ".join(f"{n} double" for n in names),
    )
    cells = long_values(rows, columns, f"{target} AS y").join(F.broadcast(limits), "pos")
    joint = (
        cells.selectExpr("pos", "y", f"{bin_sql('v', names)} AS bin")
        .groupBy("pos", "bin", "y").agg(F.count("*").alias("n"))
    )
    pos, bin_, label = F.col("pos"), F.col("bin"), F.col("y")
    sums = joint.groupingSets([[pos, bin_, label], [pos, bin_], [pos, label], [pos]], pos, bin_, label).agg(
        F.sum("n").alias("n"), F.grouping_id().alias("level")
    )
    # Levels: 0 joint, 1 bins, 2 classes, 3 all rows of the column.
    scores = sums.groupBy("pos").agg(
        F.expr("sum(CASE level WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE -1 END * n * ln(n))").alias("part"),
        F.expr("max(CASE WHEN level = 3 THEN n END)").alias("total"),
    )
    listed = local_table(df.sparkSession, list(enumerate(columns)), "pos int, feature string")
    return _ranked(
        listed.join(scores, "pos", "left").selectExpr(
            "'mutual_info' AS method", "feature", "coalesce(greatest(part / total + ln(total), 0D), 0D) AS score"
        )
    )


def aggregate_ranks(rankings: DataFrame, n: int) -> DataFrame:
    """The n features with the lowest mean rank: ``(feature, avg_rank, position)``."""
    means = rankings.groupBy("feature").agg(F.avg("rank").alias("avg_rank"))
    order = Window.orderBy("avg_rank", "feature")
    # Feature-level rows, at most n of them after the top-k.
    top = means.orderBy("avg_rank", "feature").limit(n)
    return top.withColumn("position", F.row_number().over(order) - 1)


def rankings_table(rankings: DataFrame, selected: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """One row per selected feature with its rank under each method, -1 if absent."""
    wide = (
        rankings.join(selected.select("feature"), "feature", "left_semi")
        .groupBy("feature").pivot("method", list(methods)).agg(F.first("rank"))
    )
    names = [F.col(m).cast("int").alias(f"{m}_rank") for m in methods]
    return selected.select("feature").join(wide, "feature", "left").select("feature", *names).fillna(-1)


@dataclass(frozen=True)
class Selection:
    """Result of the ensemble selection.

    ``status`` is "not_run" (few columns), "unranked" (few numeric candidates, all
    candidates kept) or "ranked".
    """

    status: str
    selected: tuple[str, ...]
    dropped: tuple[str, ...] = ()
    rankings: DataFrame | None = field(default=None, compare=False)
    ranked: DataFrame | None = field(default=None, compare=False)


def select_features(
    df: DataFrame,
    target: str,
    task: str = "multiclass",
    key: Sequence[str] = (),
    methods: Sequence[str] = METHODS,
    threshold: float = VARIANCE_THRESHOLD,
    n_trees: int = 100,
    exclude: Sequence[str] = (),
    min_columns: int = HIGH_DIMENSION,
    min_numeric: int = HIGH_DIMENSION,
    n_select: int | None = None,
) -> Selection:
    """Ensemble feature selection of wide tables.

    The first gate reads the schema only: below ``min_columns`` columns in total nothing runs.
    Below ``min_numeric`` numeric candidates all candidates are kept unranked. Of the numeric ones ``n_select`` stay, by
    default half of them and at most ``MAX_SELECTED``. ``exclude`` names columns (row keys) that are not features.

    The imputed table is written to the shared folder once, and the rankings read it there.
    """
    table = df.drop(*exclude)
    if len(table.columns) < min_columns:
        return Selection("not_run", ())
    found = candidates(table, target)
    names = [c.column for c in found]
    numeric = [c.column for c in found if c.numeric]
    if len(numeric) < min_numeric:
        return Selection("unranked", tuple(names))

    extra = [k for k in key if k not in numeric]
    rows = drop_missing_target(df, target).select(*[f"`{c}`" for c in [*extra, target, *numeric]])
    path = scratch_path(df.sparkSession, "imputed")
    impute_median(rows, numeric).write.parquet(path)
    filled = df.sparkSession.read.parquet(path)
    # Sizes, variances and correlations share one pass.
    coded, code = _coded(filled, target)
    sizes, variances, correlations = column_stats(coded, numeric, ["count(v)", VARIANCE, CORRELATION], code)
    varied = _varied(variances, numeric, threshold)
    parts = []
    if "correlation" in methods:
        parts.append(ranking(df.sparkSession, "correlation", {c: correlations.get(c) for c in varied}))
    if "mutual_info" in methods:
        parts.append(rank_mutual_info(filled, varied, target, task, counts=sizes))
    if "random_forest" in methods:
        from tabloom.operators.forest import rank_forest

        parts.append(rank_forest(filled, varied, target, task, key=key, n_trees=n_trees))
    # features x methods rows, settled so the forest is not fitted again.
    rankings, _ = settle(reduce(DataFrame.unionByName, parts))
    ranked, _ = settle(aggregate_ranks(rankings, min(MAX_SELECTED, len(numeric) // 2) if n_select is None else n_select))
    top = [r["feature"] for r in sorted(ranked.collect(), key=lambda r: r["position"])]
    selected = [n for n in names if n not in numeric] + top
    dropped = [n for n in names if n not in set(selected)]
    return Selection("ranked", tuple(selected), tuple(dropped), rankings, ranked)
