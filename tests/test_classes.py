"""Very many classes, and classes that hold most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators import balance as B
from tabloom.operators import features as FE
from tabloom.operators import metrics as M
from tabloom.operators import select as SEL
from tabloom.operators import split as S
from tabloom.operators.examples import preparation_summary
from tabloom.operators.positions import positions
from tabloom.session import settle
from tabloom.spec import LabelMap

CLASSES = 25_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """One class with 90 % of the rows, 50,000 of three rows each."""
    light = spark.range(3 * CLASSES).selectExpr("id", "concat('c', id % 25000) AS label")
    heavy = spark.range(27 * CLASSES).selectExpr(f"id + {3 * CLASSES} AS id", "'heavy' AS label")
    path = str(tmp_path_factory.mktemp("hot") / "t")
    light.unionByName(heavy).withColumn("body", F.concat_ws("/", "label", "id")).write.parquet(path)
    return spark.read.parquet(path)


def test_heavy_classes_are_few(hot):
    counts, small = SEL.class_counts(hot, "label")
    assert not small
    assert [r[0] for r in SEL.heavy_classes(counts, small).collect()] == ["heavy"]
    assert SEL.heavy_classes(counts.limit(5), True) is None


def test_rows_of_a_heavy_class_stay(hot):
    """They meet a broadcast; no side of a shuffled join reads them."""
    counts, small = SEL.class_counts(hot, "label")
    heavy = SEL.heavy_classes(counts, small)
    joined = SEL.attach(hot.withColumnRenamed("label", "_class"), counts, small, heavy=heavy)
    shown = plan(joined)
    assert "BroadcastHashJoin" in shown and "LeftAnti" in shown and "SinglePartition" not in shown
    assert joined.count() == 30 * CLASSES
    assert joined.groupBy("_class").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c")).filter("a <> b OR a <> c").isEmpty()


def test_split_of_very_many_classes(hot):
    marked = S.stratified_split(hot, "label", ["id"], 0.4)
    sides = {tuple(r) for r in marked.groupBy("split").count().collect()}
    n = 30 * CLASSES
    assert sides == {("test", math.ceil(n * 0.4)), ("train", n - math.ceil(n * 0.4))}
    per_class = marked.filter("label <> 'heavy'").groupBy("label").agg(F.count_if(F.col("split") == "test").alias("t"))
    assert {r[0] for r in per_class.select("t").distinct().collect()} <= {1, 2}
    assert "SinglePartition" not in plan(marked)


def test_undersample_very_many_classes(hot):
    kept = B.undersample(hot, "label", ["id"])
    sizes = kept.groupBy("label").count()
    assert sizes.count() == CLASSES + 1 and {r[0] for r in sizes.select("count").distinct().collect()} == {3}


def test_reports_of_very_many_classes_need_no_single_task(hot):
    report = S.split_report(hot.withColumn("split", F.lit("all")), "label")
    assert report.filter("label = 'heavy'").first()["pct"] == pytest.approx(90.0)
    assert "Window" not in plan(report)
    summary = preparation_summary(hot.withColumn("set", F.when(F.col("id") % 2 == 0, "a")), label="label")
    assert "Window" not in plan(summary)
    assert {r[0] for r in summary.select("total").distinct().collect()} == {15 * CLASSES}


def test_codes_of_very_many_classes(hot):
    coded = FE.encode_label(hot, "label")
    assert coded.columns == [*hot.columns, "y_code"] and coded.count() == hot.count()
    codes = coded.select("label", "y_code").distinct().orderBy("y_code").collect()
    assert [r["y_code"] for r in codes] == list(range(CLASSES + 1))
    assert [r["label"] for r in codes] == sorted(r["label"] for r in codes)
    assert "SinglePartition" not in plan(coded)


def test_two_million_positions(spark):
    n = 2_000_000
    rows = spark.range(n).select((F.col("id") * 7_919 % n).alias("x"), F.lit("p").alias("body"))
    placed = positions(rows, ["x"])
    assert "SinglePartition" not in plan(placed) and "Window" not in plan(placed)
    assert placed.filter("x <> pos").isEmpty() and placed.count() == n


def test_positions_within_groups_with_nulls_and_empty_tables(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = {r["i"]: r["pos"] for r in positions(df, [F.desc("x"), "i"], within=["g"]).collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in mine] == list(range(len(mine)))
    assert positions(df.limit(0), ["x"]).collect() == []
    assert positions(df, ["x", "i"], "at").columns == ["g", "x", "i", "at"]


def test_wide_class_names_are_not_held_by_the_driver(spark):
    table = spark.createDataFrame([("x" * 300, 1), ("y", 2)], "_class string, n long")
    settled, small = settle(table)
    assert not small and sorted(r["n"] for r in settled.collect()) == [1, 2]
    assert settle(table, most_chars=300)[1] and not settle(table, limit=1, most_chars=300)[1]
    nested, small = settle(table.select(F.array("_class").alias("a")))
    assert not small and nested.count() == 2


def test_labels_inferred_from_texts_are_numbered_by_ranges(spark):
    rows = spark.range(30_000).selectExpr("IF(id % 2 = 0, 'a', 'b') AS split", "concat('t', id div 2) AS label", "concat('t', id div 4) AS predict")
    tables = M.evaluate(rows, LabelMap())
    assert tables["confusion"].count() == 30_000
    assert "Window" not in plan(tables["labels"])
    labels = tables["labels"].filter("split = 'a'").orderBy("pos").collect()
    assert [r["pos"] for r in labels] == list(range(15_001)) and labels[-1]["label"] == M.UNPARSED
    assert [r["label"] for r in labels[:-1]] == sorted(r["label"] for r in labels[:-1])
    assert M.evaluate(rows.limit(10), LabelMap(), dense=True)["confusion"].count() > 10


def test_copies_of_one_key_end_the_rounds(spark, monkeypatch):
    """A bucket that holds one hash is not looked at again."""
    rows = spark.range(40_000).selectExpr("'same' AS k", "id AS body")
    seen = []
    settled = SEL.settle
    monkeypatch.setattr(SEL, "settle", lambda df, *a: seen.append(df.columns) or settled(df, *a))
    got = S.random_split(rows, ["k"], 0.3, resolve_rows=100)
    assert got.filter("split = 'test'").count() == 12_000
    assert sum("_single" in columns for columns in seen) <= 4


def _shuffled(spark, act):
    """Bytes of the shuffle files that ``act`` adds."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        names = [found.apply(i) for i in range(found.size())]
        return {f.getName(): f.length() for f in names if f.getName().endswith(".data")}

    before = files()
    act()
    return sum(n for name, n in files().items() if name not in before)


def test_rows_of_very_many_classes_are_shuffled_once(spark):
    rows = spark.range(90_000).selectExpr("id AS k", "concat('class/', id div 3) AS label", "md5(string(id)) AS body")
    once = _shuffled(spark, lambda: rows.repartition("label").write.format("noop").mode("overwrite").save())
    got = []
    # As with tables too large for a broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        taken = _shuffled(spark, lambda: got.extend(S.stratified_split(rows, "label", ["k"], 0.5).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 90_000 and sum(r["split"] == "test" for r in got) == 45_000
    assert taken < 2 * once


def test_copies_in_very_many_classes_are_told_apart_by_content(spark):
    """One key per class: the rows lowest by content are taken, of equal rows any."""
    rows = spark.range(84_000).selectExpr("'same' AS k", "if(id % 4 = 0, NULL, concat('c', id div 4 % 20997)) AS label", "string(id % 2) AS body")
    assert not SEL.class_counts(rows, "label")[1]
    marked = S.stratified_split(rows, "label", ["k"], 0.4)
    assert {tuple(r) for r in marked.groupBy("split").count().collect()} == {("test", 33_600), ("train", 50_400)}
    assert marked.drop("split").exceptAll(rows).isEmpty() and rows.exceptAll(marked.drop("split")).isEmpty()
    ranked = marked.filter("label IS NOT NULL").groupBy("label").agg(
        F.collect_list(F.struct("body", "split")).alias("g"), F.min(F.struct(SEL.content_hash(["k", "label", "body"], 42).alias("h"), "body")).alias("low"))
    wrong = ranked.filter("exists(g, x -> x.split = 'test' AND x.body <> low.body) AND exists(g, x -> x.split = 'train' AND x.body = low.body)")
    assert wrong.isEmpty()
