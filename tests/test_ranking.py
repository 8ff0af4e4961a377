import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import features as FE
from tabloom.operators.forest import baseline_predict, rank_forest
from tabloom.session import local_table


@pytest.fixture(scope="module")
def planted(spark):
    """Sixty noise columns, one that follows the class, one of almost no variance."""
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        y = rnd.choice(["neg", "pos"])
        noise = [rnd.gauss(0, 1) for _ in range(58)]
        signal = (1.5 if y == "pos" else -1.5) + rnd.gauss(0, 0.5)
        rows.append((i, y, f"row{i}", "ab"[i % 2], signal, 0.001 * rnd.random(), *noise))
    names = ["signal", "flat", *[f"n{i:02d}" for i in range(58)]]
    schema = "k int, y string, name string, kind string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


NOISE = [f"n{i:02d}" for i in range(58)]


def test_gates(spark, planted):
    narrow = planted.select("k", "y", "signal")
    assert FE.select_features(narrow, "y").status == "not_run"
    texts = planted.select("k", "y", *[F.col(n).cast("string").alias(n) for n in NOISE[:50]])
    found = FE.select_features(texts.limit(5), "y")
    assert found.status == "unranked"


def test_selection(planted):
    found = FE.select_features(planted, "y", key=["k"], exclude=["k"], methods=("correlation", "mutual_info"))
    assert found.status == "ranked"
    # Non-numeric candidates first, then the top half; identifiers are in neither list.
    assert found.selected[:2] == ("kind", "signal")
    assert len(found.selected) == 1 + 30
    assert "flat" in found.dropped and "name" not in (*found.selected, *found.dropped)
    assert len(found.dropped) == 30


def test_correlation(planted):
    local = planted.select("y", "signal", *NOISE[:3]).toPandas()
    code = (local["y"] == "pos").astype(int)
    found = {r["feature"]: r["score"] for r in FE.rank_correlation(planted, ["signal", *NOISE[:3]], "y").collect()}
    for name, score in found.items():
        assert score == pytest.approx(abs(np.corrcoef(local[name], code)[0, 1]), abs=1e-8)


def test_undefined_correlation_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, i) for i in range(5)], "same double, other double, y int")
    rows = FE.rank_correlation(df, ["same", "other"], "y").orderBy("rank").collect()
    assert [(r["feature"], r["score"]) for r in rows] == [("other", 0.0), ("same", 0.0)]


def mutual_information(xs, ys):
    n = len(xs)
    cx, cy, cxy = Counter(xs), Counter(ys), Counter(zip(xs, ys))
    return sum(m / n * math.log(m * n / (cx[x] * cy[y])) for (x, y), m in cxy.items())


def test_mutual_information(planted):
    local = planted.select("y", "signal", *NOISE[:3]).toPandas()
    found = {r["feature"]: r["score"] for r in FE.rank_mutual_info(planted, ["signal", *NOISE[:3]], "y").collect()}
    for name, score in found.items():
        edges = [local[name].quantile(i / 10) for i in range(1, 10)]
        bins = [sum(e < v for e in edges) for v in local[name]]
        assert score == pytest.approx(mutual_information(bins, list(local["y"])), abs=1e-8)


def test_variance_filter(planted):
    assert FE.variance_filter(planted, ["flat", "signal"]) == ["signal"]
    with pytest.raises(ValueError):
        FE.variance_filter(planted, ["flat"])


def test_imputation_uses_given_medians(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 3.0), (4, None), (9, float("nan"))], "a int, b double")
    assert [tuple(r) for r in FE.impute_median(df, ["a", "b"]).collect()] == [(1.0, 1.0), (4.0, 3.0), (4.0, 2.0), (9.0, 2.0)]
    assert [r["a"] for r in FE.impute_median(df, ["a"], {"a": -1.0}).collect()] == [1.0, -1.0, 4.0, 9.0]
    empty = spark.createDataFrame([(None,)], "a double")
    assert FE.impute_median(empty, ["a"]).first()["a"] is None


def test_encoding_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("C",), ("a",)], "y string")
    assert {tuple(r) for r in FE.encode_label(df, "y").collect()} == {("C", 0), ("a", 1), ("b", 2)}


def test_mean_ranks_and_table(spark):
    ranks = local_table(
        spark,
        [("m1", "a", 3.0, 0), ("m1", "b", 2.0, 1), ("m1", "c", 1.0, 2), ("m2", "b", 5.0, 0), ("m2", "a", 4.0, 1)],
        "method string, feature string, score double, rank int",
    )
    top = FE.aggregate_ranks(ranks, 3).orderBy("position").collect()
    assert [(r["feature"], r["avg_rank"]) for r in top] == [("a", 0.5), ("b", 0.5), ("c", 2.0)]
    table = FE.rankings_table(ranks, FE.aggregate_ranks(ranks, 3), ["m1", "m2"])
    assert {tuple(r) for r in table.collect()} == {("a", 0, 1), ("b", 1, 0), ("c", 2, -1)}


def test_forest_finds_the_signal_under_any_partitioning(planted):
    columns = ["signal", *NOISE[:9]]
    base = rank_forest(planted, columns, "y", key=["k"], n_trees=10, max_depth=4).orderBy("rank").collect()
    again = rank_forest(planted.repartition(3), columns, "y", key=["k"], n_trees=10, max_depth=4).orderBy("rank").collect()
    assert base[0]["feature"] == "signal" and base[0]["score"] > 0.5
    assert [r[:] for r in base] == [r[:] for r in again]


def test_regression_forest(spark):
    rnd = random.Random(5)
    rows = [(i, x := rnd.random(), rnd.random(), 3 * x) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    found = rank_forest(df, ["a", "b"], "y", "regression", key=["k"], n_trees=5, max_depth=4)
    assert found.orderBy("rank").first()["feature"] == "a"
    predicted = baseline_predict(df.filter("k < 150"), df.filter("k >= 150"), ["a", "b"], "y", "regression", ["k"], 5, 5)
    error = predicted.filter("split = 'test'").select(F.avg(F.abs(F.col("predict").cast("double") - F.col("label").cast("double")))).first()[0]
    assert error < 0.3


def test_baseline_knows_unseen_test_labels(planted):
    test = planted.limit(20).withColumn("y", F.lit("new"))
    out = baseline_predict(planted, test, ["signal"], "y", key=["k"], n_trees=5, max_depth=3)
    rows = out.filter("split = 'test'").collect()
    assert {r["label"] for r in rows} == {"new"} and {r["predict"] for r in rows} <= {"neg", "pos"}
