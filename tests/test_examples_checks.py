import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabloom.operators import checks as K
from tabloom.operators import examples as E
from tabloom.spec import LITERAL_MAP_LIMIT, LabelMap, PrepSpec


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, 30.0, "m", 1.0), (2, None, "f", 0.0), (3, 41.25, None, 1.0), (4, float("nan"), "x", None), (5, 2.5e9, "f", 2.0)],
        "k int, age double, sex string, y double",
    )


def spec(**changes):
    base = dict(
        target="y", features=("age", "sex"), instruction="Say.", mapping=LabelMap({0: "No", 1: "Yes"}), keep=("k",),
        decimals=1,
    )
    return PrepSpec(**{**base, **changes})


def texts(df):
    return {r["k"]: (r["input"], r["output"]) for r in df.collect()}


def test_examples(people):
    assert texts(E.build_examples(people, spec())) == {
        1: ("age: 30.0, sex: m", "Yes"), 2: ("sex: f", "No"), 3: ("age: 41.3, sex: _"[:9], "Yes"),
    }


def test_missing_policies(people):
    policies = E.fit_medians(people, spec(missing={"age": "median", "sex": "literal"}, unmapped="keep"))
    assert texts(E.build_examples(people, policies)) == {
        1: ("age: 30.0, sex: m", "Yes"), 2: ("age: 41.3, sex: f", "No"), 3: ("age: 41.3, sex: unknown", "Yes"),
        5: ("age: 2500000000.0, sex: f", "2.0"),
    }


def test_test_table_uses_training_medians(people, spark):
    fitted = E.fit_medians(people, spec(missing={"age": "median"}))
    other = spark.createDataFrame([(9, None, "m", 1.0)], people.schema)
    assert texts(E.build_examples(other, fitted))[9][0] == "age: 41.3, sex: m"
    with pytest.raises(ValueError):
        E.input_text(other, spec(missing={"age": "median"}))
    with pytest.raises(ValueError):
        E.build_examples(other, spec(missing={"age": "median"}))


def test_unmapped_targets_can_fail(people):
    with pytest.raises(PySparkException, match="no label for y"):
        E.build_examples(people, spec(unmapped="fail")).collect()
    with pytest.raises(ValueError):
        spec(unmapped="ignore")
    with pytest.raises(ValueError):
        spec(missing={"age": "guess"})


def test_long_mappings_are_joined(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("y"))
    mapping = LabelMap({i: f"c{i % 9}" for i in range(LITERAL_MAP_LIMIT + 100)})
    out = E.map_target(df, "y", mapping)
    assert out.count() == LITERAL_MAP_LIMIT + 100
    assert out.filter("label <> concat('c', k % 9)").isEmpty()


@pytest.mark.parametrize("more", [0, LITERAL_MAP_LIMIT])
def test_fractional_targets_do_not_depend_on_the_length(spark, more):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.5), (4, 7.0)], "k int, y double")
    pairs = [("0", "zero"), ("1", "whole"), ("1.0", "fraction"), ("2.5", "half")]
    mapping = LabelMap([*pairs, *((10_000 + i, "other") for i in range(more))])
    found = {r["k"]: r["label"] for r in E.map_target(df, "y", mapping).collect()}
    assert found == {1: "zero", 2: "fraction", 3: "half"}
    kept = {r["k"]: r["label"] for r in E.map_target(df, "y", mapping, "keep").collect()}
    assert kept == {**found, 4: "7.0"}


def test_label_map():
    mapping = LabelMap([("a", "X"), ("b", "Y"), ("c", "X")])
    assert mapping.labels == ["X", "Y"] and len(mapping) == 3


def failing(report):
    return {r["rule"]: (r["failed"], r["example_key"]) for r in report.collect()}


def test_format_rules(spark):
    good = '{"output": "x", "instruction": "i", "input": "a: 1"}'
    raw = [
        good, '{"instruction": "i", "input": "a"}', good[:-1] + ', "z": 1}', good.replace('"x"', "1"),
        good.replace('"x"', '""'), good[:-1], good.replace('"x"', "null"), "[]",
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "k int, value string")
    assert failing(K.check_format(df, "value", ["k"])) == {
        "valid_json": (2, "5"), "exact_keys": (4, "1"), "string_values": (5, "1"), "non_empty": (5, "1"),
    }


def test_row_rules(spark):
    ex = spark.createDataFrame(
        [(1, "i", "a: 1, b: 2", "Yes"), (2, "i", "a: 1, c: 2", "Yes"), (3, "i", "text", "Perhaps"), (4, "", "b: 2", None)],
        "k int, instruction string, input string, output string",
    )
    mapping = LabelMap({1: "Yes", 0: "No"})
    assert failing(K.check_labels(ex, mapping, ["k"])) == {"known_label": (2, "3")}
    assert failing(K.check_input(ex, ["a", "b"], ["k"])) == {"input_parts": (2, "2")}
    report = K.verify_examples(ex, ex.filter("k = 1").withColumn("extra", F.lit(1)), mapping, ["a", "b"], ["k"])
    rows = {(r["set"], r["rule"]): r["failed"] for r in report.collect()}
    assert rows["train", "non_empty_instruction"] == 1 and rows["train", "non_empty_output"] == 1
    assert rows["test", "known_label"] == 0 and rows["both", "same_structure"] == 1
    assert rows["both", "same_instruction"] == 1 and rows["both", "same_labels"] == 2


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(K, "IN_SET_LIMIT", 1)
    ex = spark.createDataFrame([(1, "i", "a: 1", "Yes"), (2, "i", "a: 1", "No"), (3, "i", "a: 1", "?")], "k int, instruction string, input string, output string")
    mapping = LabelMap({1: "Yes", 0: "No"})
    assert failing(K.check_labels(ex, mapping, ["k"])) == {"known_label": (1, "3")}
    assert failing(K.verify_examples(ex, None, mapping, ["a"], ["k"]))["known_label"] == (1, "3")


def test_sample(spark):
    df = spark.range(50).select(F.col("id").alias("k"))
    first = {r["k"] for r in K.sample_rows(df, ["k"]).collect()}
    assert len(first) == 3 and first == {r["k"] for r in K.sample_rows(df.repartition(7), ["k"]).collect()}
    assert K.sample_rows(df.limit(2), ["k"]).count() == 2
