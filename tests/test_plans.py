"""Shape of the plans: what must not happen at scale."""

from dataclasses import replace
from statistics import median

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tabloom.functions.labels import extract_label
from tabloom.operators import balance as B
from tabloom.operators import metrics as M
from tabloom.operators import profile as P
from tabloom.operators import split as S
from tabloom.operators.examples import build_examples
from tabloom.plans.dataset import prepare
from tabloom.plans.evaluation import score_files
from tabloom.sources.stages import StageMismatch
from tabloom.spec import LabelMap, PrepSpec
from tabloom.streaming.live import append_to, stream_examples, stream_labels
from workload.inputs import ORDER_SPEC, STATUS, predictions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, small):
    return spark.read.parquet(f"{small}/orders.parquet")


def test_examples_are_a_narrow_pruned_scan(orders):
    text = plan(build_examples(orders, ORDER_SPEC))
    assert "Exchange" not in text
    assert "PushedFilters: [IsNotNull(o_orderstatus)]" in text
    assert "o_orderdate" not in text


def test_splitting_moves_no_row(orders):
    text = plan(S.stratified_split(orders, "o_orderstatus", ["o_orderkey"]))
    assert "BroadcastHashJoin" in text
    assert not [line for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert "Window" not in text and "Sort " not in text


def test_balancing_moves_no_row(orders):
    for out in (B.undersample(orders, "o_orderstatus", ["o_orderkey"]), B.oversample(orders, "o_orderstatus", ["o_orderkey"])):
        text = plan(out)
        assert "Exchange hash" not in text and "SinglePartition" not in text and "RoundRobin" not in text


def test_selection_reads_key_and_class_only(orders):
    from tabloom.functions.keys import class_of, row_hash

    slim = orders.withColumns({"_class": class_of("o_orderstatus"), "_h": row_hash(["o_orderkey"], 42)}).select("_class", "_h")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan(slim.groupBy("_class", "_h").count())


def test_pair_counts_shuffle_once(spark, small):
    text = plan(M.pair_counts(M.score_rows(predictions(spark, small), STATUS), STATUS))
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


def test_value_table_expands_once_and_limits_before_the_exchange(orders):
    text = plan(P.value_counts(orders, ["o_orderstatus", "o_orderpriority"]))
    assert text.count("Generate posexplode") == 1
    assert "WindowGroupLimit" in text.split("Exchange hashpartitioning(column")[1]


def test_head_is_a_top_k(orders):
    assert "TakeOrderedAndProject" in plan(P.head_sample(orders, ["o_orderkey"]))


def test_no_python_outside_the_repair(spark, small):
    for name in ("build_examples", "extract_label", "parse_overrides", "parse_payload", "check_format", "stratified_split", "class_distribution", "length_report"):
        text = plan(driver.queries()[name](spark, small))
        assert "EvalPython" not in text and "InPandas" not in text, name
    assert "ArrowEvalPython" in plan(driver.queries()["repair_json"](spark, small))


def test_main_path(spark, orders, tmp_path):
    done = prepare(orders, ORDER_SPEC, ["o_orderkey"], str(tmp_path), "r1", strategy="undersample")
    assert done["examples"].count() == 1500 and done["split"].filter("split = 'test'").count() == 300
    assert {r["count"] for r in done["balanced"].groupBy("output").count().collect()} == {
        min(r["count"] for r in done["split"].filter("split = 'train'").groupBy("output").count().collect())
    }
    again = prepare(orders, ORDER_SPEC, ["o_orderkey"], str(tmp_path), "r1", strategy="none", start="split")
    assert again["balanced"].count() == 1200
    with pytest.raises(FileNotFoundError):
        prepare(orders, ORDER_SPEC, ["o_orderkey"], str(tmp_path), "other", start="split")
    with pytest.raises(StageMismatch, match="ratio"):
        prepare(orders, ORDER_SPEC, ["o_orderkey"], str(tmp_path), "r1", start="split", ratio=0.3)
    with pytest.raises(StageMismatch, match="mapping"):
        prepare(orders, replace(ORDER_SPEC, mapping=LabelMap({"O": "x"})), ["o_orderkey"], str(tmp_path), "r1", start="examples")
    with pytest.raises(StageMismatch, match="strategy"):
        prepare(orders, ORDER_SPEC, ["o_orderkey"], str(tmp_path), "r1", start="balanced", strategy="oversample")
    with pytest.raises(ValueError):
        prepare(orders, ORDER_SPEC, ["o_orderkey"], str(tmp_path), "r1", start="nowhere")


def test_main_path_with_a_test_table(spark, orders, tmp_path):
    train, test = orders.filter("o_orderkey % 4 <> 0"), orders.filter("o_orderkey % 4 = 0")
    done = prepare(train, ORDER_SPEC, ["o_orderkey"], str(tmp_path), "r1", test_table=test)
    assert done["split"].filter("split = 'test' AND o_orderkey % 4 <> 0").isEmpty()
    assert done["split"].filter("split = 'test'").count() == test.count()


def test_a_started_again_run_keeps_its_test_rows(spark, orders, tmp_path):
    train, test = orders.filter("o_orderkey % 4 <> 0"), orders.filter("o_orderkey % 4 = 0")
    run = (ORDER_SPEC, ["o_orderkey"], str(tmp_path), "r1")
    first = prepare(train, *run, test_table=test, strategy="undersample")
    n = first["balanced"].count()
    for start in ("examples", "split", "balanced"):
        again = prepare(train, *run, start=start, strategy="none" if start == "balanced" else "undersample")
        assert again["split"].filter("split = 'train' AND o_orderkey % 4 = 0").isEmpty(), start
        assert again["split"].count() == orders.count() and again["balanced"].count() == n, start


def test_medians_come_from_training_rows(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i * i) if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, y string, v double")
    spec = PrepSpec(target="y", features=("v",), instruction="Say.", missing={"v": "median"}, decimals=None)
    done = prepare(df, spec, ["k"], str(tmp_path), "r1")["split"].collect()
    train = {r["k"] for r in done if r["split"] == "train"}
    want = median(v for k, _, v in rows if v is not None and k in train)
    assert {r["input"] for r in done if r["k"] % 3 == 0} == {f"v: {want}"}


def test_score_files(spark, small, tmp_path):
    predictions(spark, small).select("label", "predict").write.json(str(tmp_path / "p"))
    found = score_files(spark, {"test": str(tmp_path / "p")}, STATUS, str(tmp_path / "out"))
    assert found["summary"].first()["total"] > 0
    assert spark.read.json(str(tmp_path / "out" / "confusion")).count() == 16
    with pytest.raises(ValueError):
        score_files(spark, {}, STATUS)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(str(tmp_path / "p"))
    row = score_files(spark, {"test": str(tmp_path / "p")}, STATUS, damaged="report")["summary"].first()
    assert row["n_damaged"] == 1 and row["total"] == found["summary"].first()["total"]


def test_streams_go_through_the_same_functions(spark, orders, tmp_path):
    orders.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in"))
    append_to(stream_examples(stream, ORDER_SPEC), str(tmp_path / "ex"), str(tmp_path / "c1")).awaitTermination()
    want = build_examples(orders, ORDER_SPEC)
    got = spark.read.parquet(str(tmp_path / "ex"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()

    texts = stream.select("o_orderkey", F.concat(F.lit("so: "), F.col("o_orderstatus"), F.lit("illed")).alias("predict"))
    append_to(stream_labels(texts, STATUS), str(tmp_path / "lb"), str(tmp_path / "c2")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "lb"))
    assert back.filter(~F.col("pred").eqNullSafe(extract_label(F.col("predict"), STATUS.labels))).isEmpty()


def test_no_single_task_over_rows(spark, small):
    """Single-partition exchanges carry per-class or per-column rows only."""
    for name in ("stratified_split", "oversample", "undersample", "extract_label", "score_rows", "build_examples", "shuffle"):
        assert "SinglePartition" not in plan(driver.queries()[name](spark, small)), name
