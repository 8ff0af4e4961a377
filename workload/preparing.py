"""Example building, checks, balancing and splitting queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tabloom.operators import balance as B
from tabloom.operators import checks as K
from tabloom.operators import examples as E
from tabloom.operators import split as S
from tabloom.spec import LabelMap
from workload.inputs import (
    CUSTOMER_GAPS_SQL, CUSTOMER_SPEC, ORDER_EXAMPLES_SQL, ORDER_INPUT_SQL, ORDER_SPEC, STATUS, STATUS_SQL, customer_gaps,
)
from workload.registry import query, table

# ---- examples ---------------------------------------------------------------


@query("map_target", f"SELECT o_orderkey, {STATUS_SQL} AS label FROM orders")
def map_target(spark, sf):
    return E.map_target(table(spark, sf, "orders"), "o_orderstatus", STATUS).select("o_orderkey", "label")


@query(
    "map_target_unmapped",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS label
    FROM orders""",
)
def map_target_unmapped(spark, sf):
    """Values outside the mapping keep their raw text."""
    from tabloom.spec import LabelMap

    mapping = LabelMap([("1-URGENT", "high"), ("2-HIGH", "high")])
    rows = E.map_target(table(spark, sf, "orders"), "o_orderpriority", mapping, "keep")
    return rows.select("o_orderkey", "label")


@query(
    "clean_features",
    f"""SELECT c_custkey, coalesce(c_nationkey::VARCHAR, 'unknown') AS c_nationkey, c_name, c_mktsegment,
      round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM ({CUSTOMER_GAPS_SQL}) m)), 6) AS c_acctbal
    FROM ({CUSTOMER_GAPS_SQL}) s""",
)
def clean_features(spark, sf):
    return E.clean_features(customer_gaps(spark, sf), CUSTOMER_SPEC).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("render_input", f"SELECT o_orderkey, {ORDER_INPUT_SQL} AS input FROM orders")
def render_input(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", E.input_text(df, ORDER_SPEC).alias("input"))


@query("build_examples", ORDER_EXAMPLES_SQL)
def build_examples(spark, sf):
    return E.build_examples(table(spark, sf, "orders"), ORDER_SPEC)


@query(
    "build_examples_gaps",
    f"""SELECT c_custkey, 'Predict the market segment.' AS instruction,
      'c_nationkey: ' || coalesce(c_nationkey::VARCHAR, 'unknown') || ', c_acctbal: ' ||
      round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM ({CUSTOMER_GAPS_SQL}) m)), 2)::DECIMAL(38,2) || ', c_name: ' || c_name AS input,
      c_mktsegment AS output FROM ({CUSTOMER_GAPS_SQL}) s WHERE c_mktsegment IS NOT NULL""",
)
def build_examples_gaps(spark, sf):
    """Missing targets dropped, missing features by policy."""
    gaps = customer_gaps(spark, sf)
    return E.build_examples(gaps, E.fit_medians(gaps, CUSTOMER_SPEC))


@query(
    "map_target_long",
    """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_custkey < 2000 THEN 'c' || (o_custkey % 9)
      ELSE o_custkey || '.0' END AS label FROM orders""",
)
def map_target_long(spark, sf):
    """A thousand whole-number keys against a target held as double; the others keep their text."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("y"))
    mapping = LabelMap({i: f"c{i % 9}" for i in range(0, 2000, 2)})
    return E.map_target(orders, "y", mapping, "keep").select("o_orderkey", "label")


# Numbers at and beyond the ends of the 64-bit whole numbers, spelled in several ways.
LARGE = {"1.0E22": "sextillion", "9223372036854775808": "two to 63", "-1e300": "low", "0.1": "tenth", "1e2": "hundred"}


@query(
    "map_target_large_numbers",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'sextillion' WHEN 1 THEN 'two to 63' WHEN 2 THEN 'low' WHEN 3 THEN 'tenth'
      ELSE 'hundred' END AS label FROM orders WHERE o_orderkey % 7 < 5""",
)
def map_target_large_numbers(spark, sf):
    value = "CASE o_orderkey % 7 WHEN 0 THEN 1e22D WHEN 1 THEN 9223372036854775808D WHEN 2 THEN -1e300D WHEN 3 THEN 0.1D WHEN 4 THEN 100D WHEN 5 THEN 7D END"
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", f"{value} AS y")
    return E.map_target(orders, "y", LabelMap(LARGE)).select("o_orderkey", "label")


@query(
    "preparation_dropped",
    f"""WITH c AS (SELECT CASE WHEN c_mktsegment IS NULL THEN 'missing_target' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'kept'
      ELSE 'no_label' END AS reason FROM ({CUSTOMER_GAPS_SQL}) s)
    SELECT r.reason, count(c.reason) AS n_rows, round(count(c.reason) * 100.0::DOUBLE / (SELECT count(*) FROM c), 6) AS pct
    FROM (VALUES ('missing_target'), ('no_label'), ('kept')) r(reason) LEFT JOIN c ON c.reason = r.reason GROUP BY 1""",
)
def preparation_dropped(spark, sf):
    """Rows that become no example, by reason."""
    spec = replace(CUSTOMER_SPEC, mapping=LabelMap({"BUILDING": "a", "MACHINERY": "b"}))
    return E.preparation_dropped(customer_gaps(spark, sf), spec).withColumn("pct", F.round("pct", 6))


@query(
    "preparation_summary",
    f"""SELECT "set", label, count(*) AS n, (sum(count(*)) OVER (PARTITION BY "set"))::BIGINT AS total,
      round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY "set"), 6) AS pct
    FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'all' END AS "set", {STATUS_SQL} AS label FROM orders) z GROUP BY 1, 2""",
)
def preparation_summary(spark, sf):
    ex = E.build_examples(table(spark, sf, "orders"), ORDER_SPEC)
    sets = ex.withColumn("set", F.when(F.col("o_orderkey") % 10 == 0, "test").otherwise("all"))
    return E.preparation_summary(sets).withColumn("pct", F.round("pct", 6))


@query(
    "length_report",
    """WITH t AS (SELECT len(list_filter(string_split_regex('Name the language. ' || text || ' ' || lang, '\\s+'), lambda z: length(z) > 0)) AS k FROM documents)
    SELECT count(*) AS examples, sum(k)::BIGINT AS total_tokens, min(k)::INTEGER AS min_tokens, round(avg(k), 6) AS mean_tokens,
      quantile_cont(k, 0.5)::DOUBLE AS p50_tokens, round(quantile_cont(k, 0.95)::DOUBLE, 6) AS p95_tokens, max(k)::INTEGER AS max_tokens,
      count(*) FILTER (k > 512) AS over_cutoff, round(count(*) FILTER (k > 512) / count(*)::DOUBLE, 6) AS over_share FROM t""",
)
def length_report(spark, sf):
    ex = table(spark, sf, "documents").select(
        F.lit("Name the language.").alias("instruction"), F.col("text").alias("input"), F.col("lang").alias("output")
    )
    report = E.length_report(ex, cutoff=512)
    return report.withColumns({c: F.round(c, 6) for c in ("mean_tokens", "p95_tokens", "over_share")})


# ---- checks -----------------------------------------------------------------

# Examples with planted faults.
FAULTY = {
    "o_orderkey": "o_orderkey",
    "instruction": "CASE WHEN o_orderkey % 50 = 1 THEN '' WHEN o_orderkey % 50 = 2 THEN 'Guess.' ELSE instruction END",
    "input": "CASE WHEN o_orderkey % 50 = 3 THEN 'no pairs here' WHEN o_orderkey % 50 = 4 THEN 'colour: red, ' || input ELSE input END",
    "output": "CASE WHEN o_orderkey % 50 = 5 THEN 'Lost' ELSE output END",
}
FAULTY_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in FAULTY.items()) + f" FROM ({ORDER_EXAMPLES_SQL}) x"
KEYED = "CAST(o_orderkey AS VARCHAR)"
ROW_RULES = {
    "non_empty_instruction": "length(instruction) > 0",
    "non_empty_input": "length(input) > 0",
    "non_empty_output": "length(output) > 0",
    "input_parts": r"regexp_full_match(input, 'o_totalprice: [^,]*, o_orderpriority: [^,]*, o_custkey: [^,]*')",
    "known_label": "output IN ('Open', 'Partly Open', 'Filled')",
}


def report_sql(source: str, rules: dict[str, str], lead: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {lead}'{rule}' AS rule, count(*) AS checked, count(*) FILTER (WHERE NOT ({ok})) AS failed,
        min({KEYED}) FILTER (WHERE NOT ({ok})) AS example_key FROM ({source}) s""" for rule, ok in rules.items()
    )


def faulty(spark, sf):
    return E.build_examples(table(spark, sf, "orders"), ORDER_SPEC).selectExpr(*[f"{e} AS {n}" for n, e in FAULTY.items()])


@query("sample_rows", f"SELECT * FROM ({ORDER_EXAMPLES_SQL}) x ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 3")
def sample_rows(spark, sf):
    return K.sample_rows(E.build_examples(table(spark, sf, "orders"), ORDER_SPEC), ["o_orderkey"])


# Raw records as JSON text: missing, extra and non-string fields, cut-off records.
RAW = """CASE o_orderkey % 50
  WHEN 1 THEN '{"instruction": "i", "input": "a: 1"}'
  WHEN 2 THEN '{"instruction": "i", "input": "a: 1", "output": "x", "note": "y"}'
  WHEN 3 THEN '{"instruction": "i", "input": "a: 1", "output": 5}'
  WHEN 4 THEN '{"instruction": "i", "input": "a: 1", "output": "x"'
  WHEN 5 THEN '{"instruction": "", "input": "a: 1", "output": "x"}'
  ELSE '{"instruction": "i", "input": "a: ' || o_orderkey || '", "output": "' || o_orderstatus || '"}' END"""


@query(
    "check_format",
    report_sql(
        f"SELECT o_orderkey, {RAW} AS value FROM orders",
        {
            "valid_json": "o_orderkey % 50 <> 4",
            "exact_keys": "json_valid(value) AND coalesce(list_sort(json_keys(CASE WHEN json_valid(value) THEN value END)) = ['input', 'instruction', 'output'], false)",
            "string_values": "o_orderkey % 50 NOT IN (1, 3, 4)",
            "non_empty": "o_orderkey % 50 NOT IN (1, 4, 5)",
        },
    ),
)
def check_format(spark, sf):
    raw = table(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW} AS value")
    return K.check_format(raw, "value", ["o_orderkey"])


@query("check_labels", report_sql(FAULTY_SQL, {"known_label": ROW_RULES["known_label"]}))
def check_labels(spark, sf):
    return K.check_labels(faulty(spark, sf), STATUS, ["o_orderkey"])


@query("check_input", report_sql(FAULTY_SQL, {"input_parts": ROW_RULES["input_parts"]}))
def check_input(spark, sf):
    return K.check_input(faulty(spark, sf), ORDER_SPEC.features, ["o_orderkey"])


_TRAIN_SQL = f"SELECT * FROM ({FAULTY_SQL}) f WHERE o_orderkey % 4 <> 0"
_TEST_SQL = f"SELECT * FROM ({FAULTY_SQL}) f WHERE o_orderkey % 4 = 0"


def sides(spark, sf):
    rows = faulty(spark, sf)
    return rows.filter("o_orderkey % 4 <> 0"), rows.filter("o_orderkey % 4 = 0")


@query(
    "check_consistency",
    f"""WITH a AS (SELECT 'instruction' AS aspect, instruction AS value FROM ({_TRAIN_SQL}) t UNION SELECT 'label', output FROM ({_TRAIN_SQL}) t),
     b AS (SELECT 'instruction' AS aspect, instruction AS value FROM ({_TEST_SQL}) t UNION SELECT 'label', output FROM ({_TEST_SQL}) t)
    SELECT aspect, value, 'train' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) l
    UNION ALL SELECT aspect, value, 'test' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) r""",
)
def check_consistency(spark, sf):
    return K.consistency_differences(*sides(spark, sf))


def _both_rule(rule: str, column: str) -> str:
    return f"""SELECT 'both' AS "set", '{rule}' AS rule, count(*) AS checked, count(*) FILTER (WHERE l IS NULL OR r IS NULL) AS failed,
      min(coalesce(l, r)) FILTER (WHERE l IS NULL OR r IS NULL) AS example_key
      FROM (SELECT DISTINCT {column} AS l FROM ({_TRAIN_SQL}) t) x FULL JOIN (SELECT DISTINCT {column} AS r FROM ({_TEST_SQL}) t) y ON l = r"""


@query(
    "verify_examples",
    " UNION ALL ".join([
        report_sql(_TRAIN_SQL, ROW_RULES, "'train' AS \"set\", "),
        report_sql(_TEST_SQL, ROW_RULES, "'test' AS \"set\", "),
        _both_rule("same_instruction", "instruction"),
        _both_rule("same_labels", "output"),
        "SELECT 'both', 'same_structure', 4, 0, NULL",
    ]),
)
def verify_examples(spark, sf):
    train, test = sides(spark, sf)
    return K.verify_examples(train, test, STATUS, ORDER_SPEC.features, ["o_orderkey"])


# ---- balancing --------------------------------------------------------------

TURN_KEY = ["conv_id", "turn"]


def rank_sql(source: str, label: str, key_text: str, order: str) -> str:
    """Rows with their seeded rank in the class and the class sizes."""
    return f"""SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42|' || {key_text}), {order}) AS rk,
      count(*) OVER (PARTITION BY {label}) AS cnt FROM ({source}) src"""


def oversample_sql(source: str, label: str, key_text: str, order: str, columns: str) -> str:
    return f"""SELECT {columns}, unnest(range(1, copies + 1))::BIGINT AS copy FROM (
      SELECT *, most // cnt + CASE WHEN rk <= most % cnt THEN 1 ELSE 0 END AS copies
      FROM (SELECT *, max(cnt) OVER () AS most FROM ({rank_sql(source, label, key_text, order)}) a) b) c"""


def undersample_sql(source: str, label: str, key_text: str, order: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, min(cnt) OVER () AS least FROM ({rank_sql(source, label, key_text, order)}) a) b
      WHERE rk <= least"""


LABELLED_SQL = "SELECT l.doc_id, quality, toxic, text, source, lang, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_LABELLED = (LABELLED_SQL, "quality", "doc_id", "doc_id", "doc_id, quality, toxic, text, source, lang, n_chars")
_TURNS = ("SELECT conv_id, turn, role, text FROM conversations", "role", "conv_id || '|' || turn", "conv_id, turn", "conv_id, turn, role, text")


def labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


@query("oversample", oversample_sql(*_LABELLED))
def oversample(spark, sf):
    return B.oversample(labelled(spark, sf), "quality", ["doc_id"])


@query("oversample_turns", oversample_sql(*_TURNS))
def oversample_turns(spark, sf):
    return B.oversample(turns(spark, sf), "role", TURN_KEY)


@query("undersample", undersample_sql(*_LABELLED))
def undersample(spark, sf):
    return B.undersample(labelled(spark, sf), "quality", ["doc_id"])


@query("balance", undersample_sql(*_TURNS))
def balance(spark, sf):
    return B.balance(turns(spark, sf), "undersample", "role", TURN_KEY)


@query("balance_none", "SELECT conv_id, turn, role, text FROM conversations")
def balance_none(spark, sf):
    return B.balance(turns(spark, sf), "none", "role", TURN_KEY)


@query(
    "shuffle",
    """SELECT o_orderkey, o_orderstatus, count(*) OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 100 AS among_first
    FROM orders""",
)
def shuffle(spark, sf):
    """The shuffled rows, marked with whether they stand among the first hundred."""
    mixed = B.shuffle(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    first = mixed.limit(100).select("o_orderkey", F.lit(True).alias("among_first"))
    return mixed.join(F.broadcast(first), "o_orderkey", "left").fillna(False, ["among_first"])


@query(
    "balance_report",
    """WITH b AS (SELECT role AS label, count(*) AS n FROM conversations GROUP BY 1)
    SELECT label, n AS n_before, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct_before, max(n) OVER () AS n_after,
      round(100.0::DOUBLE / count(*) OVER (), 6) AS pct_after FROM b""",
)
def balance_report(spark, sf):
    rows = turns(spark, sf)
    report = B.balance_report(rows, B.oversample(rows, "role", TURN_KEY), "role")
    return report.withColumns({c: F.round(c, 6) for c in ("pct_before", "pct_after")})


# ---- splitting --------------------------------------------------------------


def stratified_sql(source: str, label: str, key: str, ratio: str = "0.2", columns: str = "*", test: str = "test") -> str:
    return f"""SELECT {columns} FROM (
    WITH src AS ({source}), c AS (SELECT {label} AS lab, count(*) AS cnt FROM src GROUP BY 1),
     t AS (SELECT sum(cnt)::BIGINT AS n, (sum(cnt) - ceil(sum(cnt) * {ratio}))::BIGINT AS ntr FROM c),
     f AS (SELECT lab, cnt, (cnt * ntr) // n AS fl, (cnt * ntr) % n AS rem, ntr FROM c, t),
     g AS (SELECT *, row_number() OVER (ORDER BY rem DESC, lab) AS rr, ntr - sum(fl) OVER () AS need FROM f),
     q AS (SELECT lab, cnt - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS n_test FROM g),
     k AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42|' || {key}), {key}) AS rk FROM src)
    SELECT k.*, CASE WHEN rk <= n_test THEN '{test}' ELSE 'train' END AS split FROM k JOIN q ON k.{label} = q.lab) s"""


def random_sql(source: str, key: str, ratio: str, columns: str = "*") -> str:
    return f"""SELECT {columns} FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42|' || {key}), {key})
      <= ceil(count(*) OVER () * {ratio}) THEN 'test' ELSE 'train' END AS split FROM ({source}) src) s"""


ORDERS_SPLIT_SQL = stratified_sql("SELECT * FROM orders", "o_orderstatus", "o_orderkey", "0.2", "o_orderkey, o_orderstatus, split")


@query("stratified_split", ORDERS_SPLIT_SQL)
def stratified_split(spark, sf):
    rows = S.stratified_split(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"])
    return rows.select("o_orderkey", "o_orderstatus", "split")


@query(
    "stratified_split_lineitem",
    """SELECT l_linestatus AS label, split, count(*) AS n FROM (""" + stratified_sql(
        "SELECT l_linestatus, l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS k FROM lineitem",
        "l_linestatus", "k", "0.25", "l_linestatus, split",
    ) + """) z GROUP BY ALL""",
)
def stratified_split_lineitem(spark, sf):
    """Exact sizes although order and line number are not a unique key."""
    rows = S.stratified_split(table(spark, sf, "lineitem"), "l_linestatus", ["l_orderkey", "l_linenumber"], 0.25)
    return S.split_report(rows, "l_linestatus").drop("pct")


# Three rows a line item, so that there are many classes of a few rows each.
_MANY_SQL = """SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS label, c AS copy,
  l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || c AS k FROM lineitem, range(3) t(c)"""


def many_classes(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS label")
    return lines.selectExpr("label", "explode(sequence(0L, 2L)) AS copy").selectExpr("label", "copy", "concat_ws('|', label, copy) AS k")


@query(
    "stratified_split_many_classes",
    f"SELECT label, split, count(*) AS n FROM ({stratified_sql(_MANY_SQL, 'label', 'k', '0.5', 'label, split')}) z GROUP BY ALL",
)
def stratified_split_many_classes(spark, sf):
    """A class for every line item: class tables too large to broadcast."""
    rows = S.stratified_split(many_classes(spark, sf), "label", ["k"], 0.5)
    return rows.groupBy("label", "split").agg(F.count("*").alias("n"))


@query(
    "split_report_many",
    """SELECT l_linestatus AS split, l_orderkey::VARCHAR AS label, count(*) AS n,
      round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) AS pct FROM lineitem GROUP BY 1, 2""",
)
def split_report_many(spark, sf):
    """Two sets of very many classes."""
    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("split"), F.col("l_orderkey").cast("string").alias("label"))
    return S.split_report(rows, "label").withColumn("pct", F.round("pct", 6))


@query("random_split", random_sql("SELECT * FROM part", "p_partkey", "0.2", "p_partkey, p_retailprice, split"))
def random_split(spark, sf):
    rows = S.random_split(table(spark, sf, "part"), ["p_partkey"])
    return rows.select("p_partkey", "p_retailprice", "split")


@query("split_fallback", random_sql("SELECT * FROM region", "r_regionkey", "0.2"))
def split_fallback(spark, sf):
    """Every region is a class of one row: no stratification, a random split instead."""
    return S.split(table(spark, sf, "region"), ["r_regionkey"], "r_name")


@query("split_regression", random_sql("SELECT * FROM part", "p_partkey", "0.3", "p_partkey, split"))
def split_regression(spark, sf):
    rows = S.split(table(spark, sf, "part"), ["p_partkey"], "p_retailprice", 0.3, task="regression")
    return rows.select("p_partkey", "split")


@query("assign_split", "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM supplier")
def assign_split(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return S.assign_split(rows.filter("s_suppkey % 3 <> 0"), rows.filter("s_suppkey % 3 = 0"))


@query(
    "split_report",
    f"""SELECT split, o_orderstatus AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS pct
    FROM ({ORDERS_SPLIT_SQL}) s GROUP BY 1, 2""",
)
def split_report(spark, sf):
    rows = S.stratified_split(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"])
    return S.split_report(rows, "o_orderstatus").withColumn("pct", F.round("pct", 6))


@query(
    "holdout",
    stratified_sql(
        f"SELECT o_orderkey, o_orderstatus FROM ({ORDERS_SPLIT_SQL}) s WHERE split = 'train'", "o_orderstatus", "o_orderkey",
        "0.05", "o_orderkey, o_orderstatus, split", "validation",
    ),
)
def holdout(spark, sf):
    rows = stratified_split(spark, sf).filter("split = 'train'")
    return S.holdout(rows, ["o_orderkey"], "o_orderstatus")
