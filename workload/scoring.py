"""Evaluation queries over predictions derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.labels import extract_label
from tabloom.operators import metrics as M
from workload.inputs import (
    BINARY, BINARY_PREDICTIONS_SQL, LABELS, PREDICTIONS_SQL, SCORED_SQL, STATUS, UNIVERSE_SQL, binary_predictions,
    extract_sql, predictions,
)
from workload.registry import query, table
from tabloom.spec import LabelMap

INSIDE = "('Open', 'Partly Open', 'Filled', 'UNPARSED')"
VALID_SQL = f"SELECT * FROM ({SCORED_SQL}) v WHERE truth IN {INSIDE} AND pred IN {INSIDE}"
COUNTS_SQL = f"SELECT split, truth, pred, count(*) AS n FROM ({VALID_SQL}) v GROUP BY ALL"


def scores_sql(counts: str, universe: str) -> str:
    return f"""SELECT u.split, u.pos, u.label, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS "precision",
      coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall,
      coalesce(2 * hits / nullif(support + predicted, 0)::DOUBLE, 0) AS f1, support, predicted
    FROM (SELECT u.split, u.pos, u.label,
        coalesce((SELECT sum(n) FROM ({counts}) c WHERE c.split = u.split AND c.truth = u.label AND c.pred = u.label), 0)::BIGINT AS hits,
        coalesce((SELECT sum(n) FROM ({counts}) c WHERE c.split = u.split AND c.truth = u.label), 0)::BIGINT AS support,
        coalesce((SELECT sum(n) FROM ({counts}) c WHERE c.split = u.split AND c.pred = u.label), 0)::BIGINT AS predicted
      FROM ({universe}) u) u"""


SCORES_SQL = scores_sql(COUNTS_SQL, UNIVERSE_SQL)
F1_SQL = f"""SELECT split, round(avg(f1) FILTER (support + predicted > 0), 6) AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM ({SCORES_SQL}) s GROUP BY split"""
VALIDITY_SQL = f"""SELECT split, count(*) AS total, count(*) FILTER (truth IN {INSIDE} AND pred IN {INSIDE}) AS valid,
  count(*) FILTER (NOT (truth IN {INSIDE} AND pred IN {INSIDE})) AS invalid,
  round(count(*) FILTER (truth = pred AND pred IN {INSIDE}) / (count(*) FILTER (truth IN {INSIDE} AND pred IN {INSIDE}))::DOUBLE, 6) AS accuracy,
  NULL::VARCHAR AS error FROM ({SCORED_SQL}) v GROUP BY split"""


def _counts(spark, sf):
    return M.pair_counts(M.score_rows(predictions(spark, sf), STATUS), STATUS)


def _universe(spark, sf):
    return M.label_universe(M.score_rows(predictions(spark, sf), STATUS), STATUS)


def _scores(spark, sf):
    """The universe is read off the counts too, so both share one exchange."""
    counts = _counts(spark, sf)
    return M.label_scores(counts, M.label_universe(counts, STATUS))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("extract_label", f"SELECT o_orderkey, {extract_sql('predict')} AS pred FROM ({PREDICTIONS_SQL}) p")
def extract(spark, sf):
    return predictions(spark, sf).select("o_orderkey", extract_label(F.col("predict"), LABELS).alias("pred"))


@query("score_rows", SCORED_SQL)
def score_rows(spark, sf):
    return M.score_rows(predictions(spark, sf), STATUS).select("o_orderkey", "split", "truth", "pred")


@query("label_universe", UNIVERSE_SQL)
def label_universe(spark, sf):
    return _universe(spark, sf)


@query(
    "label_universe_inferred",
    f"""SELECT split, (row_number() OVER (PARTITION BY split ORDER BY last, label) - 1)::INTEGER AS pos, label FROM (
      SELECT DISTINCT split, 0 AS last, trim(label) AS label FROM ({PREDICTIONS_SQL}) p WHERE trim(label) <> ''
      UNION ALL SELECT DISTINCT split, 1, 'UNPARSED' FROM ({PREDICTIONS_SQL}) p) u""",
)
def label_universe_inferred(spark, sf):
    """Without a mapping the truths of each split are its labels."""
    empty = LabelMap()
    return M.label_universe(M.score_rows(predictions(spark, sf), empty), empty)


@query("validity", VALIDITY_SQL)
def validity(spark, sf):
    return rounded(M.validity(_counts(spark, sf)), "accuracy")


@query("accuracy", f"SELECT split, round(avg((truth = pred)::INTEGER), 6) AS accuracy FROM ({VALID_SQL}) v GROUP BY split")
def accuracy(spark, sf):
    return rounded(M.accuracy(_counts(spark, sf)), "accuracy")


_BINARY_SCORED = f"""SELECT split, label AS truth, CASE WHEN lower(predict) = 'done' THEN 'Done' ELSE 'Pending' END AS pred
  FROM ({BINARY_PREDICTIONS_SQL}) b"""


@query(
    "binary_f1",
    f"""SELECT split, round(2.0::DOUBLE * count(*) FILTER (truth = 'Done' AND pred = 'Done')
      / (count(*) FILTER (truth = 'Done') + count(*) FILTER (pred = 'Done')), 6) AS f1 FROM ({_BINARY_SCORED}) s GROUP BY split""",
)
def binary_f1(spark, sf):
    """Two mapped labels, the UNPARSED marker not counted."""
    scored = M.score_rows(binary_predictions(spark, sf), BINARY)
    scores = M.label_scores(M.pair_counts(scored, BINARY), M.label_universe(scored, BINARY))
    return rounded(M.binary_f1(scores, "mapping"), "f1")


@query("f1_scores", F1_SQL)
def f1_scores(spark, sf):
    return rounded(M.f1_scores(_scores(spark, sf)), "macro_f1", "weighted_f1")


@query(
    "label_scores",
    f"""SELECT split, pos, label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted
    FROM ({SCORES_SQL}) s""",
)
def label_scores(spark, sf):
    return rounded(_scores(spark, sf), "precision", "recall", "f1")


MATRIX_SQL = f"""SELECT t.split, t.label AS truth, p.label AS pred, coalesce(n, 0)::BIGINT AS n
  FROM ({UNIVERSE_SQL}) t JOIN ({UNIVERSE_SQL}) p ON t.split = p.split
  LEFT JOIN ({COUNTS_SQL}) c ON c.split = t.split AND c.truth = t.label AND c.pred = p.label"""


@query("confusion_matrix", MATRIX_SQL)
def confusion_matrix(spark, sf):
    counts = _counts(spark, sf)
    return M.confusion_matrix(counts, M.label_universe(counts, STATUS))


@query(
    "confusion_sparse",
    """SELECT 'all' AS split, truth, pred, count(*) AS n FROM (SELECT o_custkey::VARCHAR AS truth,
      CASE WHEN o_orderkey % 3 = 0 THEN (SELECT min(o_custkey) FROM orders) ELSE o_custkey END::VARCHAR AS pred FROM orders) p GROUP BY ALL""",
)
def confusion_sparse(spark, sf):
    """As many labels as customers, only the cells that occur."""
    orders = table(spark, sf, "orders")
    least = orders.agg(F.min("o_custkey")).scalar()
    pred = F.when(F.col("o_orderkey") % 3 == 0, least).otherwise(F.col("o_custkey"))
    rows = orders.select(F.lit("all").alias("split"), F.col("o_custkey").cast("string").alias("label"), pred.cast("string").alias("predict"))
    return M.evaluate(rows, LabelMap(), dense=False)["confusion"]


@query(
    "confusion_wide",
    "SELECT split, truth, " + ", ".join(
        f"""coalesce(sum(n) FILTER (pred = '{v}'), 0)::BIGINT AS "{v}" """ for v in (*LABELS, "UNPARSED")
    ) + f" FROM ({MATRIX_SQL}) m GROUP BY ALL",
)
def confusion_wide(spark, sf):
    return M.confusion_wide(confusion_matrix(spark, sf), [*LABELS, "UNPARSED"])


REPORT_SQL = f"""WITH s AS ({SCORES_SQL})
  SELECT split, label AS "row", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
  UNION ALL SELECT split, 'accuracy', NULL, NULL, round(sum(recall * support) / sum(support), 6), sum(support)::BIGINT FROM s GROUP BY split
  UNION ALL SELECT split, 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM s GROUP BY split
  UNION ALL SELECT split, 'weighted avg', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM s GROUP BY split"""


@query("classification_report", REPORT_SQL)
def classification_report(spark, sf):
    return rounded(M.classification_report(_scores(spark, sf)), "precision", "recall", "f1")


@query(
    "evaluate",
    f"""SELECT v.split, total, valid, invalid, accuracy, error, NULL::DOUBLE AS f1, macro_f1, weighted_f1
    FROM ({VALIDITY_SQL}) v JOIN ({F1_SQL}) f ON v.split = f.split""",
)
def evaluate(spark, sf):
    """The summary table of a full evaluation."""
    found = M.evaluate(predictions(spark, sf), STATUS)["summary"]
    return rounded(found, "accuracy", "f1", "macro_f1", "weighted_f1")


@query("evaluate_labels", UNIVERSE_SQL)
def evaluate_labels(spark, sf):
    return M.evaluate(predictions(spark, sf), STATUS)["labels"]


@query("evaluate_confusion", MATRIX_SQL)
def evaluate_confusion(spark, sf):
    return M.evaluate(predictions(spark, sf), STATUS)["confusion"]


@query("evaluate_report", REPORT_SQL)
def evaluate_report(spark, sf):
    return rounded(M.evaluate(predictions(spark, sf), STATUS)["report"], "precision", "recall", "f1")


@query(
    "binary_f1_universe",
    f"""SELECT split, round(2.0::DOUBLE * count(*) FILTER (truth = 'Done' AND pred = 'Done')
      / (count(*) FILTER (truth = 'Done') + count(*) FILTER (pred = 'Done')), 6) AS f1 FROM ({_BINARY_SCORED}) s GROUP BY split""",
)
def binary_f1_universe(spark, sf):
    """The default: a universe of two labels, one of which is the marker itself."""
    mapping = LabelMap([("F", "Done"), ("O", M.UNPARSED), ("P", M.UNPARSED)])
    renamed = binary_predictions(spark, sf).withColumns(
        {c: F.when(F.lower(c) == "done", F.col(c)).otherwise(F.lit(M.UNPARSED)) for c in ("label", "predict")})
    scored = M.score_rows(renamed, mapping)
    return rounded(M.binary_f1(M.label_scores(M.pair_counts(scored, mapping), M.label_universe(scored, mapping))), "f1")


@query(
    "evaluate_many_labels",
    """SELECT l_linestatus AS split, l_partkey::VARCHAR AS truth, (l_partkey - l_partkey % 2)::VARCHAR AS pred, count(*) AS n FROM lineitem
    WHERE (l_linestatus, l_partkey - l_partkey % 2) IN (SELECT (l_linestatus, l_partkey) FROM lineitem) GROUP BY ALL""",
)
def evaluate_many_labels(spark, sf):
    """Labels inferred from the truths: only cells that occur, though nothing asks for that."""
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_linestatus AS split", "CAST(l_partkey AS STRING) AS label", "CAST(l_partkey - l_partkey % 2 AS STRING) AS predict")
    return M.evaluate(rows, LabelMap())["confusion"]


# Five thousand labels, some contained in others.
_MANY = [f"part {i}" for i in range(1, 5001)]


@query(
    "extract_label_many",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'PART ' || (l_partkey % 5000 + 1)
        WHEN 1 THEN ' Part ' || (l_partkey % 5000 + 1) || ' it is' WHEN 2 THEN 'I say part ' || (l_partkey % 5000 + 1) || '!' ELSE ' none ' END AS text,
        l_partkey % 5000 + 1 AS x, l_linenumber % 4 AS kind FROM lineitem)
    SELECT l_orderkey, l_linenumber, text, CASE kind WHEN 0 THEN 'part ' || x WHEN 3 THEN 'none'
      ELSE 'part ' || substr(x::VARCHAR, 1, 1) END AS label FROM p""",
)
def extract_label_many(spark, sf):
    """An equal label wins, else the first of the labels that start the text or occur in it: the one-digit one."""
    text = """CASE l_linenumber % 4 WHEN 0 THEN 'PART ' || (l_partkey % 5000 + 1) WHEN 1 THEN ' Part ' || (l_partkey % 5000 + 1) || ' it is'
      WHEN 2 THEN 'I say part ' || (l_partkey % 5000 + 1) || '!' ELSE ' none ' END"""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{text} AS text")
    return rows.withColumn("label", extract_label(F.col("text"), _MANY))
