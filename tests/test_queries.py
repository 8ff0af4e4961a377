"""Every registered query against its SQL, or for rows where SQL cannot say it."""

import pytest

import __spark_entry__ as driver
from tests.oracle import compare

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    rows, problems = compare(spark, small, QUERIES[name], ORACLES[name])
    assert not problems, problems
    assert rows > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 6


def test_forest_ranks_every_feature(spark, small):
    ranks = QUERIES["rank_forest"](spark, small).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(64))
    assert sum(r["score"] for r in ranks) == pytest.approx(1, abs=1e-6)


def test_full_ensemble(spark, small):
    rows = QUERIES["select_features_forest"](spark, small).collect()
    assert len(rows) == 32
    assert all(r["random_forest_rank"] >= 0 for r in rows)


def test_baseline_predicts_every_row(spark, small):
    rows = QUERIES["baseline_predict"](spark, small)
    assert {tuple(r) for r in rows.groupBy("split").count().collect()} == {("train", 1200), ("test", 300)}
    assert rows.filter("predict NOT IN ('F', 'O', 'P')").isEmpty()
