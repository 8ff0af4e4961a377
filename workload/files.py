"""Source and sink queries: each writes given tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import features as FE
from tabloom.operators import metrics as M
from tabloom.operators.examples import build_examples
from tabloom.plans.dataset import prepare
from tabloom.plans.evaluation import score_files
from tabloom.session import scratch_path
from tabloom.sources.examples import array_lines, read_examples, read_predictions, write_examples
from tabloom.sources.reports import write_metrics, write_rankings
from tabloom.sources.stages import manifests, read_stage, write_stage
from tabloom.sources.tables import read_table, scan_health, schema_alignment
from tabloom.streaming.live import append_to, stream_examples, stream_labels
from workload.inputs import CUSTOMER_GAPS_SQL, ORDER_EXAMPLES_SQL, ORDER_SPEC, STATUS, customer_gaps, extract_sql, predictions
from workload.inputs import PREDICTIONS_SQL, STATUS_SQL
from workload.preparing import oversample_sql, stratified_sql
from workload.ranking import _selection
from workload.registry import ORACLES, query, table
from workload.scoring import rounded


@query(
    "scan_csv",
    f"""SELECT c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment, c_custkey % 2 = 0 AS even
    FROM ({CUSTOMER_GAPS_SQL}) s""",
)
def scan_csv(spark, sf):
    """Types are inferred again from text; the gaps are written as NA, empty and null."""
    path = scratch_path(spark, "customer_csv")
    gaps = customer_gaps(spark, sf).select(
        "c_custkey", "c_name", F.coalesce(F.col("c_nationkey").cast("string"), F.lit("NA")).alias("c_nationkey"),
        "c_acctbal", F.coalesce("c_mktsegment", F.lit("null")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 2 == 0, "True").otherwise("False").alias("even"),
    )
    gaps.write.csv(path, header=True)
    return read_table(spark, path)


def _broken_lines(spark, sf):
    """A CSV table in which every third name runs over two lines, and the size of a block: one file takes 20 or more."""
    path = scratch_path(spark, "customer_lines")
    customers = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("\n"), "c_mktsegment")).otherwise(F.col("c_name"))
    customers.select("c_custkey", name.alias("c_name"), "c_acctbal").write.csv(path, header=True, escape='"')
    return path, max(256, 2 * customers.count())


@query(
    "scan_csv_multiline",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || c_mktsegment ELSE c_name END AS c_name, c_acctbal FROM customer",
)
def scan_csv_multiline(spark, sf):
    """Blocks of one file go to different tasks, and begin anywhere in a cell."""
    path, block_bytes = _broken_lines(spark, sf)
    return read_table(spark, path, block_bytes=block_bytes)


@query("scan_health_multiline", "SELECT true AS ok, 3::INTEGER AS n_columns, count(*) AS n_rows, 0::BIGINT AS n_corrupt, 'ok' AS message FROM customer")
def scan_health_multiline(spark, sf):
    path, block_bytes = _broken_lines(spark, sf)
    return scan_health(spark, path, block_bytes=block_bytes).drop("path")


@query("examples_array", ORDER_EXAMPLES_SQL.replace("o_orderkey, ", "", 1))
def examples_array(spark, sf):
    """One JSON array over several lines a record, read in 20 blocks or more."""
    path = scratch_path(spark, "examples_array")
    ex = build_examples(table(spark, sf, "orders"), ORDER_SPEC)
    record = F.regexp_replace(F.to_json(F.struct("instruction", "input", "output")), '","', '",\n  "')
    # The array is one file on purpose, so one task writes it.
    array_lines(ex.select(record)).write.text(path)
    return read_examples(spark, path, block_bytes=max(256, 4 * ex.count()))


@query(
    "schema_alignment",
    """SELECT column_name AS "column", 'missing in test' AS side FROM (DESCRIBE SELECT * FROM orders)
      WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 AS doubled FROM orders))
    UNION ALL SELECT 'doubled', 'missing in train'""",
)
def alignment(spark, sf):
    orders = table(spark, sf, "orders")
    return schema_alignment(orders, orders.select("o_orderkey", "o_custkey", "o_totalprice").withColumn("doubled", F.col("o_totalprice") * 2))


@query(
    "scan_health",
    """SELECT true AS ok, 3::INTEGER AS n_columns, count(*) AS n_rows, count(*) FILTER (o_orderkey % 50 = 7) AS n_corrupt,
      count(*) FILTER (o_orderkey % 50 = 7) || ' of ' || count(*) || ' records do not fit the header' AS message FROM orders""",
)
def health(spark, sf):
    """Every fiftieth record has lost a cell."""
    path = scratch_path(spark, "orders_damaged")
    price = F.when(F.col("o_orderkey") % 50 != 7, F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", price)
    # One column holding the whole line, so that nothing is quoted or completed.
    lines = table(spark, sf, "orders").select(line.alias("key,status,price"))
    lines.write.csv(path, header=True, sep="\u0001", quote="\u0000")
    return scan_health(spark, path).drop("path")


@query(
    "examples_roundtrip",
    f"SELECT instruction, input, output, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM ({ORDER_EXAMPLES_SQL}) x",
)
def examples_roundtrip(spark, sf):
    """JSON lines, one folder per split."""
    path = scratch_path(spark, "examples")
    ex = build_examples(table(spark, sf, "orders"), ORDER_SPEC)
    sides = ex.select("instruction", "input", "output", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"))
    write_examples(sides, path, "json", ["split"])
    parts = [read_examples(spark, f"{path}/split={s}", "json").withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query(
    "predictions_read",
    f"""SELECT split, label, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE predict END AS predict FROM ({PREDICTIONS_SQL}) p""",
)
def predictions_read(spark, sf):
    """Records under both field names, with fields and whole lines missing."""
    path = scratch_path(spark, "predictions")
    record = (
        F.when(F.col("o_orderkey") % 4 == 3, F.to_json(F.struct("label")))
        .when(F.col("o_orderkey") % 4 == 2, F.to_json(F.struct(F.col("label").alias("ground_truth"), F.col("predict").alias("prediction"))))
        .otherwise(F.to_json(F.struct("label", "predict")))
    )
    padded = F.when(F.col("o_orderkey") % 3 == 0, F.concat(record, F.lit("\n\n"))).otherwise(record)
    predictions(spark, sf).select("split", padded.alias("value")).write.partitionBy("split").text(path)
    return read_predictions(spark, f"{path}/split=train", "train").unionByName(read_predictions(spark, f"{path}/split=test", "test"))


@query(
    "predictions_damaged",
    f"""SELECT 'all' AS split, CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE label END AS label,
      CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE predict END AS predict, o_orderkey % 10 = 9 AS damaged FROM ({PREDICTIONS_SQL}) p""",
)
def predictions_damaged(spark, sf):
    """Every tenth line has lost its end."""
    path = scratch_path(spark, "predictions_damaged")
    record = F.to_json(F.struct("label", "predict"))
    cut = F.when(F.col("o_orderkey") % 10 == 9, F.substr(record, F.lit(1), F.length(record) - 1)).otherwise(record)
    predictions(spark, sf).select(cut.alias("value")).write.text(path)
    return read_predictions(spark, path, "all", damaged="report")


@query("rankings_sink", ORACLES["rankings_table"])
def rankings_sink(spark, sf):
    path = scratch_path(spark, "rankings")
    found = _selection(spark, sf)
    write_rankings(FE.rankings_table(found.rankings, found.ranked), found.selected, path)
    back = read_table(spark, f"{path}/feature_rankings")
    names = spark.read.text(f"{path}/selected_features").withColumnRenamed("value", "feature")
    return back.join(names, "feature").select("feature", *[F.col(c).cast("int") for c in back.columns if c != "feature"])


_SUMMARY_FIELDS = "split string, total bigint, valid bigint, invalid bigint, accuracy double, macro_f1 double, weighted_f1 double"


@query("metrics_sink", f"SELECT split, total, valid, invalid, accuracy, macro_f1, weighted_f1 FROM ({ORACLES['evaluate']}) e")
def metrics_sink(spark, sf):
    path = scratch_path(spark, "metrics")
    write_metrics(M.evaluate(predictions(spark, sf), STATUS), path)
    back = spark.read.schema(_SUMMARY_FIELDS).json(f"{path}/summary")
    return rounded(back, "accuracy", "macro_f1", "weighted_f1")


@query("score_files", f"SELECT split, total, valid, invalid, accuracy, macro_f1, weighted_f1 FROM ({ORACLES['evaluate']}) e")
def score_files_query(spark, sf):
    """Prediction files of both splits to metrics."""
    path = scratch_path(spark, "scored")
    predictions(spark, sf).select("split", "label", "predict").write.partitionBy("split").json(path)
    files = {s: f"{path}/split={s}" for s in ("train", "test")}
    found = score_files(spark, files, STATUS)["summary"].select("split", "total", "valid", "invalid", "accuracy", "macro_f1", "weighted_f1")
    return rounded(found, "accuracy", "macro_f1", "weighted_f1")


@query("stage_roundtrip", ORDER_EXAMPLES_SQL)
def stage_roundtrip(spark, sf):
    root = scratch_path(spark, "stages")
    ex = build_examples(table(spark, sf, "orders"), ORDER_SPEC)
    write_stage(ex.filter("o_orderkey % 2 = 0"), root, "older", "examples")
    write_stage(ex, root, "run1", "examples")
    return read_stage(spark, root, "run1", "examples")


@query(
    "stage_manifest",
    """SELECT 'examples' AS stage, r AS run_id, v::BIGINT AS version, count(o_orderkey) FILTER (o_orderkey % m = 0) AS n_rows, true AS readable
    FROM orders, (VALUES ('older', 1, 2), ('run1', 1, 3), ('run1', 2, 1)) t(r, v, m) GROUP BY 1, 2, 3""",
)
def stage_manifest(spark, sf):
    """Versions of two runs as published; the newest of a run is read."""
    root = scratch_path(spark, "manifests")
    ex = build_examples(table(spark, sf, "orders"), ORDER_SPEC)
    for run, part in (("older", 2), ("run1", 3), ("run1", 1)):
        write_stage(ex.filter(f"o_orderkey % {part} = 0"), root, run, "examples", {"part": part})
    found = manifests(spark, root, "examples")
    newest = read_stage(spark, root, "run1", "examples", {"part": 1}).count()
    return found.select("stage", "run_id", "version", "n_rows", (F.lit(newest) >= F.col("n_rows")).alias("readable"))


_PREPARED = stratified_sql(ORDER_EXAMPLES_SQL, "output", "o_orderkey", "0.2")


@query("prepare_split", f"SELECT o_orderkey, instruction, input, output, split FROM ({_PREPARED}) s")
def prepare_split(spark, sf):
    """The main path up to the split stage, started again from the saved examples."""
    root = scratch_path(spark, "prepare")
    orders = table(spark, sf, "orders")
    prepare(orders, ORDER_SPEC, ["o_orderkey"], root, "run1")
    return prepare(orders, ORDER_SPEC, ["o_orderkey"], root, "run1", start="examples")["split"]


@query(
    "prepare_balanced",
    oversample_sql(
        f"SELECT o_orderkey, output FROM ({_PREPARED}) s WHERE split = 'train'", "output", "o_orderkey", "o_orderkey", "o_orderkey, output"
    ),
)
def prepare_balanced(spark, sf):
    """Only the training side is balanced, so no copy reaches the test side."""
    root = scratch_path(spark, "balanced")
    done = prepare(table(spark, sf, "orders"), ORDER_SPEC, ["o_orderkey"], root, "run1", strategy="oversample")
    return done["balanced"].select("o_orderkey", "output", "copy")


@query(
    "prepare_resumed_test",
    f"SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM ({ORDER_EXAMPLES_SQL}) x",
)
def prepare_resumed_test(spark, sf):
    """A run with a test table, started again without naming it: no test row may train."""
    root = scratch_path(spark, "resumed")
    orders = table(spark, sf, "orders")
    train, test = orders.filter("o_orderkey % 4 <> 0"), orders.filter("o_orderkey % 4 = 0")
    prepare(train, ORDER_SPEC, ["o_orderkey"], root, "run1", test_table=test)
    return prepare(train, ORDER_SPEC, ["o_orderkey"], root, "run1", start="examples")["split"]


def _stream(spark, sf, name):
    # A file stream takes folders or patterns, not a single file.
    df = table(spark, sf, name)
    return spark.readStream.schema(df.schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_examples", ORDER_EXAMPLES_SQL)
def stream_examples_query(spark, sf):
    """The example builder on a stream of rows, appended to files."""
    out, state = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_state")
    append_to(stream_examples(_stream(spark, sf, "orders"), ORDER_SPEC), out, state).awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_labels",
    f"SELECT o_orderkey, predict, {extract_sql('predict')} AS pred FROM (SELECT o_orderkey, 'It is ' || {STATUS_SQL} AS predict FROM orders) p",
)
def stream_labels_query(spark, sf):
    out, state = scratch_path(spark, "labels_out"), scratch_path(spark, "labels_state")
    rows = _stream(spark, sf, "orders").selectExpr("o_orderkey", f"'It is ' || {STATUS_SQL} AS predict")
    append_to(stream_labels(rows, STATUS), out, state).awaitTermination()
    return spark.read.parquet(out)
