"""Inputs derived from the given tables, once for Spark and once as SQL text.

The given tables hold no missing values, no predictions and no broken examples, so
these are planted by key arithmetic. Both engines read the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.spec import LabelMap, PrepSpec
from workload.registry import table

# Customers with missing cells.
CUSTOMER_GAPS = {
    "c_custkey": "c_custkey",
    "c_name": "c_name",
    "c_nationkey": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END",
    "c_acctbal": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END",
    "c_mktsegment": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END",
}
CUSTOMER_GAPS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in CUSTOMER_GAPS.items()) + " FROM customer"


def customer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in CUSTOMER_GAPS.items()])


# Order status as the class to predict; the order of the labels matters, because
# "Open" is contained in "Partly Open".
STATUS = LabelMap([("O", "Open"), ("P", "Partly Open"), ("F", "Filled")])
STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Partly Open' ELSE 'Filled' END"

ORDER_SPEC = PrepSpec(
    target="o_orderstatus",
    features=("o_totalprice", "o_orderpriority", "o_custkey"),
    instruction="Predict the status of the order.",
    mapping=STATUS,
    keep=("o_orderkey",),
)
ORDER_INPUT_SQL = (
    "'o_totalprice: ' || o_totalprice::DECIMAL(38,2) || ', o_orderpriority: ' || o_orderpriority "
    "|| ', o_custkey: ' || o_custkey"
)
ORDER_EXAMPLES_SQL = (
    f"SELECT o_orderkey, 'Predict the status of the order.' AS instruction, {ORDER_INPUT_SQL} AS input, "
    f"{STATUS_SQL} AS output FROM orders"
)

CUSTOMER_SPEC = PrepSpec(
    target="c_mktsegment",
    features=("c_nationkey", "c_acctbal", "c_name"),
    instruction="Predict the market segment.",
    missing={"c_nationkey": "literal", "c_acctbal": "median"},
    keep=("c_custkey",),
)

# Free-text predictions of the order status.
PREDICT_SQL = """CASE o_orderkey % 8
    WHEN 0 THEN lower(label) WHEN 1 THEN label || ' (fairly sure)'
    WHEN 2 THEN 'Verdict so far: ' || label || '!' WHEN 3 THEN 'Open'
    WHEN 4 THEN '' WHEN 5 THEN 'garbage' WHEN 6 THEN '  ' || label || ' '
    ELSE label END"""
PREDICTIONS_SQL = f"""SELECT o_orderkey, split, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE label END AS label,
    {PREDICT_SQL} AS predict
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
               {STATUS_SQL} AS label FROM orders) z"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREDICTIONS_SQL.replace("FROM orders)", "FROM {orders})"), orders=table(spark, sf_dir, "orders"))


# The same three tiers of label extraction, as SQL.
LABELS = STATUS.labels


def extract_sql(column: str) -> str:
    text = f"trim({column})"
    whens = [f"WHEN lower({text}) = '{v.lower()}' THEN '{v}'" for v in LABELS]
    whens += [f"WHEN starts_with(lower({text}), '{v.lower()}') THEN '{v}'" for v in LABELS]
    whens += [f"WHEN contains(lower({text}), '{v.lower()}') THEN '{v}'" for v in LABELS]
    return f"CASE {' '.join(whens)} ELSE nullif({text}, '') END"


SCORED_SQL = f"""SELECT o_orderkey, split, truth, coalesce(pred, 'UNPARSED') AS pred FROM (
  SELECT o_orderkey, split, {extract_sql('label')} AS truth, {extract_sql('predict')} AS pred
  FROM ({PREDICTIONS_SQL}) p) s WHERE truth IS NOT NULL"""
UNIVERSE_SQL = (
    "SELECT split, pos, label FROM (VALUES (0, 'Open'), (1, 'Partly Open'), (2, 'Filled'), (3, 'UNPARSED')) "
    "u(pos, label), (VALUES ('test'), ('train')) s(split)"
)

# Two-class variant: was the order finished?
BINARY = LabelMap([("F", "Done"), ("O", "Pending"), ("P", "Pending")])
BINARY_PREDICTIONS_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE o_orderstatus WHEN 'F' THEN 'Done' ELSE 'Pending' END AS label,
    CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 7 = 0 THEN 'Still pending' ELSE
      CASE o_orderstatus WHEN 'F' THEN 'Done' ELSE 'Pending' END END AS predict FROM orders"""


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BINARY_PREDICTIONS_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


# Embeddings widened to one column per element, with gaps.
DIM = 64
WIDE = [f"e{i:02d}" for i in range(DIM)]
VARIANCE = 0.0155
# Imputed gaps lower the variances, so the ensemble queries use a lower limit.
GAP_VARIANCE = 0.0125


def wide_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = [f"CAST(embedding[{i}] AS DOUBLE) AS {n}" for i, n in enumerate(WIDE)]
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", *elements)


def wide_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = [f"CASE WHEN vec_id % 7 <> {i % 7} THEN {n} END AS {n}" for i, n in enumerate(WIDE)]
    return wide_embeddings(spark, sf_dir).selectExpr("vec_id", "label", *gaps)


TALL_SQL = """SELECT vec_id, label, i, 'e' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, v FROM (
  SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) z"""
TALL_GAPS_SQL = f"SELECT vec_id, label, i, feature, CASE WHEN vec_id % 7 <> i % 7 THEN v END AS v FROM ({TALL_SQL}) t"
