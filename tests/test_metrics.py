"""Metrics against a row-by-row computation."""

import random
from collections import Counter

import pytest

from tabloom.operators import metrics as M
from tabloom.spec import LabelMap


def read(text, labels):
    text = (text or "").strip()
    for test in (lambda t, v: t == v, str.startswith, str.__contains__):
        for v in labels:
            if test(text.lower(), v.lower()):
                return v
    return text or None


def brute_force(rows, mapping):
    pairs = [(read(t, mapping.labels), read(p, mapping.labels) or M.UNPARSED) for t, p in rows]
    pairs = [(t, p) for t, p in pairs if t is not None]
    labels = mapping.labels or sorted({t for t, _ in pairs})
    labels = labels if M.UNPARSED in labels else [*labels, M.UNPARSED]
    valid = [(t, p) for t, p in pairs if t in labels and p in labels]
    f1, support = {}, Counter(t for t, _ in valid)
    predicted, hits = Counter(p for _, p in valid), Counter(t for t, p in valid if t == p)
    for v in labels:
        f1[v] = 2 * hits[v] / (support[v] + predicted[v]) if support[v] + predicted[v] else 0.0
    present = [v for v in labels if support[v] + predicted[v]]
    return {
        "total": len(pairs), "valid": len(valid), "accuracy": sum(hits.values()) / len(valid),
        "macro_f1": sum(f1[v] for v in present) / len(present),
        "weighted_f1": sum(f1[v] * support[v] for v in labels) / len(valid),
        "macro_all": sum(f1.values()) / len(labels), "matrix": Counter(valid), "labels": labels,
    }


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    texts = ["Yes", "no", " Maybe ", "yes, sure", "it is no", "", "garbage", "Maybe not", "YES"]
    return [(rnd.choice(["Yes", "No", "Maybe", "", "Yes"]), rnd.choice(texts)) for _ in range(500)]


@pytest.mark.parametrize(
    "mapping",
    [LabelMap({"1": "Yes", "0": "No", "2": "Maybe"}), LabelMap(), LabelMap({"1": "Yes", "0": "No", "2": "No"}), LabelMap({"a": "UNPARSED", "b": "Yes", "c": "No"})],
)
def test_against_brute_force(spark, rows, mapping):
    want = brute_force(rows, mapping)
    df = spark.createDataFrame([("test", t, p) for t, p in rows], "split string, label string, predict string")
    found = M.evaluate(df, mapping, ["test"], dense=True)
    got = found["summary"].first()
    assert (got["total"], got["valid"], got["invalid"]) == (want["total"], want["valid"], want["total"] - want["valid"])
    for name in ("accuracy", "macro_f1", "weighted_f1"):
        assert got[name] == pytest.approx(want[name])
    assert got["f1"] is None and got["error"] is None
    assert [r["label"] for r in found["labels"].orderBy("pos").collect()] == want["labels"]
    matrix = {(r["truth"], r["pred"]): r["n"] for r in found["confusion"].collect()}
    assert len(matrix) == len(want["labels"]) ** 2
    assert {k: n for k, n in matrix.items() if n} == dict(want["matrix"])
    report = {r["row"]: r for r in found["report"].collect()}
    assert report["macro avg"]["f1"] == pytest.approx(want["macro_all"])
    assert report["accuracy"]["f1"] == pytest.approx(want["accuracy"])
    assert report["weighted avg"]["support"] == want["valid"]


def test_binary_f1_needs_two_labels(spark):
    data = [("test", "Yes", p) for p in ["yes", "no", "Yes"]] + [("test", "No", p) for p in ["no", "yes"]]
    df = spark.createDataFrame(data, "split string, label string, predict string")
    mapping = LabelMap({"1": "Yes", "0": "No"})
    usual = M.evaluate(df, mapping)["summary"].first()
    assert usual["f1"] is None and usual["macro_f1"] is not None
    on_mapping = M.evaluate(df, mapping, binary_f1_on="mapping")["summary"].first()
    assert on_mapping["f1"] == pytest.approx(2 * 2 / (3 + 3)) and on_mapping["macro_f1"] is None
    # UNPARSED as one of two mapped labels makes the universe binary.
    two = LabelMap({"1": "Yes", "x": "UNPARSED"})
    only = spark.createDataFrame([("test", "Yes", "yes"), ("test", "Yes", "")], "split string, label string, predict string")
    assert M.evaluate(only, two)["summary"].first()["f1"] == pytest.approx(2 / 3)


def test_splits_without_rows_or_labels(spark):
    df = spark.createDataFrame(
        [("train", "Yes", "yes"), ("blank", "", "yes"), ("odd", "other", "thing")], "split string, label string, predict string"
    )
    found = M.evaluate(df, LabelMap({"1": "Yes"}), ["train", "blank", "odd", "test"])
    rows = {r["split"]: r for r in found["summary"].collect()}
    assert rows["train"]["error"] is None and rows["train"]["accuracy"] == 1
    assert rows["blank"]["error"] == rows["test"]["error"] == M.NO_LABELS
    assert rows["odd"]["error"] == M.NO_PREDICTIONS and rows["odd"]["invalid"] == 1
    assert {r["split"] for r in found["report"].collect()} == {"train"}
    assert {r["split"] for r in M.evaluate(df, LabelMap({"1": "Yes"}))["summary"].collect()} == {"train", "blank", "odd"}


def test_wide_matrix(spark, rows):
    mapping = LabelMap({"1": "Yes", "0": "No"})
    df = spark.createDataFrame([("test", t, p) for t, p in rows], "split string, label string, predict string")
    wide = M.confusion_wide(M.evaluate(df, mapping)["confusion"], ["Yes", "No", "UNPARSED"])
    assert wide.columns == ["split", "truth", "Yes", "No", "UNPARSED"] and wide.count() == 3


@pytest.mark.parametrize("labels", [6, 40])
def test_zero_cells_are_the_callers_choice(spark, labels):
    df = spark.createDataFrame([("s", f"l{i}", f"l{i}") for i in range(labels)], "split string, label string, predict string")
    assert M.evaluate(df, LabelMap(), dense=False)["confusion"].count() == labels == M.evaluate(df, LabelMap())["confusion"].count()
    k = M.evaluate(df, LabelMap())["labels"].count()
    assert M.evaluate(df, LabelMap(), dense=True)["confusion"].count() == k * k
