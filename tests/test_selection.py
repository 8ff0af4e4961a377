"""Splits and balancing: exact sizes, repeatability, hot keys and hot classes."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.operators import balance as B
from tabloom.operators import split as S
from tabloom.operators.select import pick_lowest, repeat_rows
from tabloom.session import local_table


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def brute_force_train(counts, n_train):
    total = sum(counts.values())
    got = {c: n * n_train // total for c, n in counts.items()}
    order = sorted(counts, key=lambda c: (-(counts[c] * n_train % total), c))
    for c in order[: n_train - sum(got.values())]:
        got[c] += 1
    return got


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; classes of very different size."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 7 == 0, "some").otherwise("most").alias("label"),
        (F.col("id") % 4).alias("v"),
    )


@pytest.mark.parametrize("resolve_rows", [10**6, 200, 1])
@pytest.mark.parametrize("ratio", [0.2, 0.37, 0.9])
def test_sizes_are_exact_with_a_hot_key(skewed, resolve_rows, ratio):
    out = S.stratified_split(skewed, "label", ["k"], ratio, resolve_rows=resolve_rows)
    n_train, n_test = S.split_sizes(3000, ratio)
    counts = dict(rows_of(skewed.select("label").groupBy("label").count()).keys())
    expected = brute_force_train(counts, n_train)
    got = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert {c: got["train", c] for c in counts} == expected
    # Whole result: the input rows, each once.
    assert rows_of(out.drop("split")) == rows_of(skewed)


def test_same_split_under_any_partitioning_and_refinement(skewed):
    base = rows_of(S.stratified_split(skewed, "label", ["k"]))
    assert rows_of(S.stratified_split(skewed.repartition(5, "v"), "label", ["k"])) == base
    assert rows_of(S.stratified_split(skewed.coalesce(1), "label", ["k"], resolve_rows=50)) == base


def test_unique_keys_follow_the_seeded_order(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("label"))
    out = S.random_split(df, ["k"], 0.3)
    order = sorted(range(500), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    assert {r["k"] for r in out.filter("split = 'test'").collect()} == set(order[:150])
    assert rows_of(S.random_split(df, ["k"], 0.3, seed=7)) != rows_of(out)


def test_identical_rows_are_counted_out(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.lit("a").alias("label"))
    out = S.random_split(df, ["k"], 0.25)
    assert rows_of(out) == {(1, "a", "test"): 250, (1, "a", "train"): 750}


def test_many_classes_stay_distributed(spark, monkeypatch):
    """Beyond the driver limit the class tables are checkpointed and joined."""
    import tabloom.operators.select as sel
    import tabloom.session as session

    small = session.settle
    monkeypatch.setattr(sel, "settle", lambda df, limit=3: small(df, 3))
    monkeypatch.setattr(S, "settle", lambda df, limit=3: small(df, 3))
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 20).cast("string").alias("label"))
    out = S.stratified_split(df, "label", ["k"], 0.25, resolve_rows=4)
    assert set(rows_of(out.groupBy("split", "label").count()).values()) == {1}
    assert {r["count"] for r in out.filter("split = 'test'").groupBy("label").count().collect()} == {5}


def test_missing_label_is_a_class(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("label"))
    got = S.split_report(S.stratified_split(df, "label", ["k"]), "label").collect()
    assert {(r["split"], r["label"]): r["n"] for r in got} == {
        ("train", ""): 40, ("test", ""): 10, ("train", "a"): 40, ("test", "a"): 10,
    }


def test_impossible_stratification(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.when(F.col("id") == 0, "one").otherwise("rest").alias("label"))
    with pytest.raises(S.StratificationError):
        S.stratified_split(df, "label", ["k"])
    assert S.split(df, ["k"], "label").filter("split = 'test'").count() == 2
    many = spark.range(10).select(F.col("id").alias("k"), (F.col("id") % 5).alias("label"))
    with pytest.raises(S.StratificationError):
        S.stratified_split(many, "label", ["k"], 0.2)
    with pytest.raises(ValueError):
        S.random_split(df, ["k"], 1.0)


def test_sizes():
    for n in (2, 3, 7, 10, 99, 1000):
        for ratio in (0.05, 0.1, 0.2, 0.5):
            train, test = S.split_sizes(n, ratio)
            assert test == math.ceil(n * ratio) and train + test == n


def test_holdout(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 2).alias("label"))
    out = S.holdout(df, ["k"], "label")
    assert {tuple(r) for r in out.groupBy("split").count().collect()} == {("train", 190), ("validation", 10)}


def test_pick_lowest_quota_edges(spark):
    df = spark.range(20).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("g"))
    quotas = local_table(spark, [("0", 10, 0), ("1", 10, 10)], "_class string, n long, q long")
    out = pick_lowest(df, ["k"], quotas, "g")
    assert {(r["g"], r["picked"]) for r in out.collect()} == {("0", False), ("1", True)}


def test_oversample_keeps_every_original(skewed):
    out = B.oversample(skewed, "label", ["k"])
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert set(counts.values()) == {max(counts.values())}
    assert rows_of(out.filter("copy = 1").drop("copy")) == rows_of(skewed)


def test_oversample_spreads_the_copies_of_one_row(spark):
    df = spark.range(5001).select(F.col("id").alias("k"), F.when(F.col("id") == 0, "one").otherwise("rest").alias("label"))
    out = B.oversample(df, "label", ["k"])
    one = out.filter("label = 'one'")
    assert one.count() == 5000 and one.select("copy").distinct().count() == 5000
    assert one.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("most", [1, 16, 17, 300, 5000])
def test_repeat_rows(spark, most):
    df = local_table(spark, [(0, 0), (1, 1), (2, most)], "k int, times long")
    out = repeat_rows(df, "times", "copy", most)
    assert sorted(r["copy"] for r in out.filter("k = 2").collect()) == list(range(1, most + 1))
    assert out.filter("k = 0").isEmpty() and out.filter("k = 1").count() == 1


def test_undersample(skewed):
    out = B.undersample(skewed, "label", ["k"])
    assert {r["count"] for r in out.groupBy("label").count().collect()} == {60}
    assert not rows_of(out) - rows_of(skewed)


def test_balancing_after_the_split_leaks_nothing(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("label"))
    marked = S.stratified_split(df, "label", ["k"])
    train = B.oversample(marked.filter("split = 'train'"), "label", ["k"])
    assert train.join(marked.filter("split = 'test'"), "k").isEmpty()


def test_strategy_names(skewed):
    assert rows_of(B.balance(skewed, "none", "label", ["k"])) == rows_of(skewed)
    with pytest.raises(ValueError):
        B.balance(skewed, "other", "label", ["k"])


def test_shuffle_spreads_a_hot_key(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"))
    sizes = B.shuffle(df, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 20000


def test_shuffle_repeats(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey")
    first = [r[0] for r in B.shuffle(df, ["o_orderkey"]).collect()]
    assert first == [r[0] for r in B.shuffle(df.repartition(3), ["o_orderkey"]).collect()]
    assert first != sorted(first) and sorted(first) == sorted(r[0] for r in df.collect())


def test_balance_report(skewed):
    report = {r["label"]: r for r in B.balance_report(skewed, B.undersample(skewed, "label", ["k"]), "label").collect()}
    assert report["rare"]["n_before"] == 60 and report["most"]["n_after"] == 60
    assert sum(r["pct_before"] for r in report.values()) == pytest.approx(100)
