"""Tree models: feature importance and the baseline predictor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import plain_sql, quoted
from tabloom.operators.columns import drop_missing_target
from tabloom.operators.features import ranking
from tabloom.operators.select import pick_lowest
from tabloom.session import local_table

# Size and seed of the forest.
N_TREES = 100
SEED = 42

MAX_DEPTH = 10
# Rows that a forest is fitted on at most.
MAX_FIT_ROWS = 1_000_000


def _fit_rows(df: DataFrame, key: Sequence[str], max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows, the same ones in the same partitions whatever the input layout, so that a seed repeats.

    The rows lowest in a seeded hash of the key (without key: of the whole row) are picked where they are; only
    these move. Rows are dealt by their whole content: one hot key spreads over all tasks.
    """
    body = F.xxhash64(*[quoted(c) for c in df.columns])
    if not key:
        df, key = df.withColumn("_row", body), ["_row"]
    n = df.count()
    if n > max_rows:
        quota = local_table(df.sparkSession, [("", n, max_rows)], "_class string, n long, q long")
        df = pick_lowest(df, key, quota, seed=SEED, into="_fit").filter("_fit").drop("_fit")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, body).sortWithinPartitions(*[F.col(quoted(k)) for k in key], body)


def _model(task: str, label: str, n_trees: int, max_depth: int):
    common = dict(
        featuresCol="_features", labelCol=label, numTrees=n_trees, maxDepth=max_depth, seed=SEED,
        maxMemoryInMB=512,
    )
    if task == "regression":
        return RandomForestRegressor(featureSubsetStrategy="all", predictionCol="_prediction", **common)
    return RandomForestClassifier(featureSubsetStrategy="sqrt", predictionCol="_prediction", **common)


def _prepared(df: DataFrame, columns: Sequence[str], y: str, task: str, key: Sequence[str], max_rows: int) -> DataFrame:
    keys = [f"{quoted(k)} AS _k{i}" for i, k in enumerate(key)]
    return _fit_rows(
        drop_missing_target(df, y).selectExpr(*keys, f"{_target_sql(y, task)} AS _y", *_values_sql(columns)),
        [f"_k{i}" for i in range(len(key))], max_rows,
    )


def _target_sql(y: str, task: str) -> str:
    return plain_sql(y) if task == "regression" else f"CAST({quoted(y)} AS STRING)"


def _values_sql(columns: Sequence[str]) -> list[str]:
    return [f"coalesce({plain_sql(c)}, 0D) AS _x{i}" for i, c in enumerate(columns)]


def rank_forest(
    df: DataFrame,
    columns: Sequence[str],
    y: str,
    task: str = "multiclass",
    key: Sequence[str] = (),
    n_trees: int = N_TREES,
    max_depth: int = MAX_DEPTH,
    max_fit_rows: int = MAX_FIT_ROWS,
) -> DataFrame:
    """Forest importance per feature; the columns are expected to be imputed.

    The forest is fitted on at most ``max_fit_rows`` rows, those lowest in the seeded order of ``key``; result and order of rows
    do not depend on the input partitioning.
    """
    rows = _prepared(df, columns, y, task, key, max_fit_rows)
    stages = [VectorAssembler(inputCols=[f"_x{i}" for i in range(len(columns))], outputCol="_features")]
    label = "_y"
    if task != "regression":
        stages.append(StringIndexer(inputCol="_y", outputCol="_label", stringOrderType="alphabetAsc"))
        label = "_label"
    fitted = Pipeline(stages=[*stages, _model(task, label, n_trees, max_depth)]).fit(rows)
    weights = fitted.stages[-1].featureImportances.toArray()
    return ranking(
        df.sparkSession, "random_forest", {c: float(w) for c, w in zip(columns, weights)}
    )


def baseline_predict(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str],
    y: str,
    task: str = "multiclass",
    key: Sequence[str] = (),
    n_trees: int = 20,
    max_depth: int = 5,
    max_fit_rows: int = MAX_FIT_ROWS,
) -> DataFrame:
    """Fit a forest on train and predict both sides: ``(*key, split, label, predict)``.

    Text columns are not used; missing numbers count as 0. Fitted on at most ``max_fit_rows`` rows, all are predicted.
    """
    rows = _prepared(train, columns, y, task, key, max_fit_rows)
    assemble = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(columns))], outputCol="_features")
    if task == "regression":
        stages = [assemble, _model(task, "_y", n_trees, max_depth)]
        shown = F.col("_prediction").cast("string")
    else:
        indexer = StringIndexer(
            inputCol="_y", outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep"
        ).fit(rows)
        back = IndexToString(inputCol="_prediction", outputCol="_shown", labels=indexer.labels)
        stages = [assemble, indexer, _model(task, "_label", n_trees, max_depth), back]
        shown = F.col("_shown")
    model = Pipeline(stages=stages).fit(rows)

    both = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True
    )
    scored = model.transform(both.selectExpr("*", f"{_target_sql(y, task)} AS _y", *_values_sql(columns)))
    return scored.select(
        *key, "split", F.coalesce(F.col(f"`{y}`").cast("string"), F.lit("")).alias("label"), shown.alias("predict")
    )
