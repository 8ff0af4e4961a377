import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import columns as C
from tabloom.operators import profile as P
from tabloom.operators.quantiles import medians, quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    rnd = random.Random(3)
    rows = [
        (
            rnd.gauss(0, 1),
            float(rnd.choice([1, 1, 1, 2, 5])),
            None if rnd.random() < 0.3 else rnd.randint(-50, 50),
            float("nan") if i % 3 == 0 else rnd.choice([-0.0, 0.0, 1.5]),
            7.0,
            None,
            rnd.choice([float("-inf"), float("inf"), 0.5]) if i % 5 == 0 else float(i),
        )
        for i in range(4000)
    ]
    return spark.createDataFrame(rows, "a double, dup double, gaps int, nan double, same double, none double, inf double")


@pytest.mark.parametrize("resolve", [10**6, 900, 40, 1])
def test_quantiles_are_exact(numbers, resolve):
    """The result does not depend on how often a column is cut into pieces."""
    found = quantiles(numbers, numbers.columns, PROBS, resolve_values=resolve)
    local = numbers.toPandas()
    for c in numbers.columns:
        values = pd.to_numeric(local[c], errors="coerce").dropna()
        if values.empty:
            assert found[c] == [None] * len(PROBS)
            continue
        ordered = sorted(values)
        for p, got in zip(PROBS, found[c]):
            at = p * (len(ordered) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert got == pytest.approx(want, rel=1e-12, abs=1e-12), (c, p)


def test_medians_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    assert medians(empty, ["x"]) == {"x": None}
    assert medians(empty, []) == {}


@pytest.mark.parametrize("distinct", [1, 9, 10, 11, 19, 20, 21, 47])
def test_low_cardinality_limits(spark, distinct):
    """Texts up to 20 values, anything else up to 10."""
    grown = spark.range(94).select(
        F.concat(F.lit("soil "), F.col("id") % distinct).alias("soil"), (F.col("id") % distinct / 4).alias("moisture"),
        F.date_add(F.lit("2021-03-01").cast("date"), (F.col("id") % distinct).cast("int")).alias("sown"),
    )
    found = {r["column"]: r["n_unique"] for r in P.categorical_columns(grown).collect()}
    want = {"soil": 20, "moisture": 10, "sown": 20}
    assert found == {c: distinct for c, most in want.items() if distinct <= most}
    assert {r["column"] for r in P.value_counts(grown).collect()} == set(found)


def test_value_counts_keep_the_missing_bucket_and_ten_values(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else f"v{i % 17:02d}",) for i in range(400)], "c string")
    rows = sorted(P.value_counts(df, ["c"]).collect(), key=lambda r: r["rank"])
    assert len(rows) == 10 and rows[0]["value"] is None and rows[0]["n"] == 100


def test_profile_counts(numbers):
    rows = {r["column"]: r for r in P.column_profile(numbers).collect()}
    assert rows["nan"]["n_missing"] == 1334 and rows["nan"]["n_unique"] == 2
    assert rows["none"]["n_missing"] == 4000 and rows["none"]["n_unique"] == 0
    assert rows["a"]["n_unique"] == 4000


def test_a_profile_is_cut_on_request_only(spark):
    df = spark.range(3).select(*[F.lit(i).alias(f"c{i:02d}") for i in range(65)])
    rows = P.column_profile(df).collect()
    assert len(rows) == 65 and rows[0]["n_more"] == 0
    rows = P.column_profile(df, 60).collect()
    assert len(rows) == 60 and rows[0]["n_more"] == 5
    assert P.numeric_summary(df).count() == 65 and P.numeric_summary(df, 20).count() == 20
    assert {r["column"] for r in P.value_counts(df).collect()} == set(df.columns)


def test_profile_tables(spark, small):
    df = spark.read.parquet(f"{small}/customer.parquet")
    exact, rough = P.profile(df, ["c_custkey"]), P.profile(df, ["c_custkey"], approximate=True)
    assert exact["shape"].first()[:] == (150, 5)
    assert exact["head"].count() == 5
    for name in ("value_counts", "categorical"):
        assert {r["column"] for r in exact[name].collect()} == {r["column"] for r in rough[name].collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert {(r["column"], r["n_unique"], r["n_rows"]) for r in P.column_profile(df).collect()} == {("a", 0, 0), ("b", 0, 0)}
    assert P.class_distribution(df, "b").isEmpty()
    assert P.table_shape(df).first()["n_rows"] == 0


@pytest.mark.parametrize("distinct, expected", [(100, True), (52, True), (51, True), (50, False), (49, False), (3, False)])
def test_identifier_limit_is_exact(spark, distinct, expected):
    """More than half of all rows, counted with missing ones."""
    df = spark.range(100).select((F.col("id") % distinct).cast("string").alias("s"), "id")
    assert C.identifier_columns(df).count() == int(expected)


def test_candidates(spark):
    df = spark.createDataFrame(
        [(i, f"p{i}", i % 2 == 0, "x", float(i), "s", i % 2) for i in range(20)],
        "ID int, name string, flag boolean, kind string, value double, Source_File string, target int",
    )
    assert [tuple(r) for r in C.feature_candidates(df, "target").orderBy("position").collect()] == [
        ("flag", 2, True), ("kind", 3, False), ("value", 4, True),
    ]


def test_missing_targets(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "y double")
    assert C.drop_missing_target(df, "y").count() == 1


def test_feature_edits():
    edit = C.edit_features(["age", "bmi", "Smoker", "weight"], ["age", "bmi", "Smoker"], drop=["smoker"])
    assert edit.selected == ("age", "bmi") and edit.dropped == ("Smoker",)
    edit = C.edit_features(["age", "Weight"], ["age"], ["Weight"], add=["weight", "nope", "AGE"])
    assert edit.selected == ("age", "Weight") and edit.dropped == () and edit.unknown == ("nope",)
    edit = C.edit_features([], ["age", "bmi", "smoker", "height"], keep_only=["age", " BMI "])
    assert edit.selected == ("age", "bmi") and edit.dropped == ("smoker", "height")
