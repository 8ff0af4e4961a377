"""Frequent values, approximate summaries, and mutual information by neighbours."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import frequent as Q
from tabloom.operators import neighbours as N
from tabloom.operators import profile as P


def test_summary_bounds_hold():
    draw = random.Random(2)
    true, summary = Counter(), Q.Summary(20)
    for _ in range(50):
        batch = Counter(str(int(draw.paretovariate(0.7))) for _ in range(300))
        true.update(batch)
        summary.add(list(batch), list(batch.values()))
        assert len(summary.counts) <= 20
    assert summary.error <= 50 * 300 / 21
    for value, n in true.items():
        assert summary.counts.get(value, 0) <= n <= summary.counts.get(value, 0) + summary.error


@pytest.fixture(scope="module")
def skewed(spark):
    draw = random.Random(3)
    rows = []
    for i in range(30_000):
        hot = draw.random()
        a = None if hot < 0.1 else f"h{int(hot * 20)}" if hot < 0.4 else f"u{draw.randrange(10**9)}"
        rows.append((a, "long " * 40 + str(int(draw.paretovariate(1))), draw.choice([-0.0, 0.0, 1.5, float("nan")]), draw.choice([True, False])))
    return spark.createDataFrame(rows, "a string, b string, c double, flag boolean").repartition(6).cache()


def test_frequent_values_equal_exact_counts(skewed):
    got = Q.frequent_values(skewed, k=5, counters=200, candidates=100)
    want = P.value_counts(skewed, skewed.columns, k=5)
    listed = {(r["column"], r["rank"]): (r["value"], r["n"]) for r in want.collect()}
    rows = got.collect()
    for r in rows:
        if r["n"] > r["n_others"] or r["column"] in ("c", "flag"):
            assert listed[r["column"], r["rank"]] == (r["value"], r["n"])
    assert sum(r["column"] == "a" and r["n"] > r["n_others"] for r in rows) == 5
    assert [r["n"] for r in sorted(rows, key=lambda r: r["rank"]) if r["column"] == "flag"] == [v[1] for k, v in sorted(listed.items()) if k[0] == "flag"]


def test_bounds_cover_every_value_that_is_not_listed(skewed):
    for counters, candidates in ((50, 20), (200, 100), (1_000_000, 500)):
        got = Q.frequent_values(skewed, ["a", "b"], k=5, counters=counters, candidates=candidates).collect()
        for c in ("a", "b"):
            counts = {r[0]: r[1] for r in skewed.groupBy(c).count().collect()}
            mine = [r for r in got if r["column"] == c]
            assert all(counts[r["value"]] == r["n"] for r in mine)
            rest = max(n for v, n in counts.items() if v not in {r["value"] for r in mine})
            assert all(rest <= r["n_others"] for r in mine)


def test_values_do_not_move(skewed):
    shown = Q.frequent_values(skewed, ["a"], k=3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown


def test_no_rows_and_too_many_asked(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert Q.frequent_values(df).collect() == []
    with pytest.raises(ValueError):
        Q.frequent_values(df, k=600)


@pytest.mark.parametrize("shape", ["normal", "heavy", "few"])
def test_sketched_quartiles_keep_their_error(spark, shape):
    draw = np.random.default_rng(4)
    values = {"normal": draw.normal(size=60_000), "heavy": draw.pareto(0.5, 60_000), "few": draw.integers(0, 4, 60_000).astype(float)}[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").withColumn("none", F.lit(None).cast("double")).repartition(8)
    rows = {r["column"]: r for r in P.numeric_summary(df, digits=15, approximate=True).collect()}
    assert rows["none"]["p50"] is None and rows["none"]["count"] == 0
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        v = rows["x"][name]
        assert np.mean(values < v) <= p + P.SKETCH_RANK_ERROR and np.mean(values <= v) >= p - P.SKETCH_RANK_ERROR
    exact = P.numeric_summary(df, digits=15).filter("column = 'x'").first()
    assert (rows["x"]["count"], rows["x"]["min"], rows["x"]["max"]) == (exact["count"], exact["min"], exact["max"])


def test_approximate_profile_sketches_quartiles(spark, small):
    df = spark.read.parquet(f"{small}/customer.parquet")
    assert P.profile(df, ["c_custkey"], approximate=True)["numeric"].count() == P.profile(df, ["c_custkey"])["numeric"].count()


def brute_mutual_info(values, classes, k):
    """The estimator by all pairs."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    sizes = Counter(c for v, c in zip(values, classes) if v is not None)
    rows = [(v, c) for v, c in zip(values, classes) if v is not None and sizes[c] > 1]
    if not rows:
        return 0.0
    total = 0.0
    for i, (v, c) in enumerate(rows):
        same = sorted(abs(w - v) for j, (w, d) in enumerate(rows) if d == c and j != i)
        kk = min(k, len(same))
        radius = same[kk - 1]
        m = sum(abs(w - v) < radius or w == v for w, _ in rows)
        total += psi(kk) - psi(len(same) + 1) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("block_rows", [7, 50, 200_000])
def test_mutual_information_equals_all_pairs(spark, block_rows):
    draw = random.Random(5)
    rows = []
    for i in range(150):
        y = draw.choice(["a", "b", "c"]) if i else "alone"
        x = {"a": 0.0, "b": 1.0, "c": 1.5, "alone": 9.0}[y] + draw.gauss(0, 0.5)
        rows.append((y, x, float(draw.randint(0, 3)), draw.random() / 3 if draw.random() < 0.7 else None, None, 1e16 + draw.choice([0.0, 2.0, 4.0])))
    rows.append((None, 1.0, 1.0, 1.0, 1.0, 1.0))
    names = ["signal", "ties", "gaps", "none", "large"]
    df = spark.createDataFrame(rows, "y string, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {r["feature"]: r["score"] for r in N.rank_mutual_info_knn(df, names, "y", block_rows=block_rows).collect()}
    kept = [r for r in rows if r[0] is not None]
    for i, name in enumerate(names, 1):
        assert got[name] == pytest.approx(brute_mutual_info([r[i] for r in kept], [r[0] for r in kept], 3), abs=2e-9), name
    assert got["signal"] > got["gaps"]


def test_digamma_series(spark):
    row = spark.range(1).selectExpr(*[f"{N.digamma(str(n))} AS d{n}" for n in (1, 2, 3, 10, 1000)]).first()
    for n, value in zip((1, 2, 3, 10, 1000), row):
        assert value == pytest.approx(-0.5772156649015329 + math.fsum(1 / i for i in range(1, n)), abs=1e-12)
