"""Profiling and column-choice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import columns as C
from tabloom.operators import profile as P
from tabloom.operators.frequent import frequent_values
from workload.inputs import CUSTOMER_GAPS_SQL, WIDE, customer_gaps, wide_embeddings
from workload.registry import query, table

CUSTOMER = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
PART = [
    ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
    ("p_size", "int"), ("p_retailprice", "double"),
]
LINEITEM = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]


def numbers(columns):
    return [c for c, t in columns if t in ("bigint", "int", "double")]


def profile_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i}::INTEGER AS position, '{c}' AS "column", '{t}' AS dtype, {str(t in ('bigint', 'int', 'double'))} AS "numeric",
        {str(t in ('string', 'timestamp_ntz'))} AS text_like, count(DISTINCT {c}) AS n_unique,
        count(*) - count({c}) AS n_missing, count(*) AS n_rows FROM ({source}) s"""
        for i, (c, t) in enumerate(columns)
    )


def summary_sql(source: str, columns) -> str:
    stats = (
        ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("p25", "quantile_cont({c}, 0.25)"),
        ("p50", "quantile_cont({c}, 0.5)"), ("p75", "quantile_cont({c}, 0.75)"), ("max", "max({c})"),
    )
    return " UNION ALL ".join(
        f"""SELECT {i}::INTEGER AS position, '{c}' AS "column", count({c}) AS "count", """
        + ", ".join(f'round(({e.format(c=c + "::DOUBLE")})::DOUBLE, 4) AS "{n}"' for n, e in stats)
        + f" FROM ({source}) s"
        for i, c in enumerate(numbers(columns))
    )


def value_sql(source: str, names) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n FROM ({source}) s GROUP BY ALL""" for c in names
    )


def top_sql(source: str, names) -> str:
    return f"""SELECT "column", value, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column"
      ORDER BY n DESC, value NULLS FIRST) AS rank FROM ({value_sql(source, names)}) v) r WHERE rank <= 10"""


CATEGORICAL = "((text_like AND n_unique <= 20) OR n_unique <= 10)"


@query("table_shape", "SELECT count(*) AS n_rows, 11::INTEGER AS n_columns FROM lineitem")
def table_shape(spark, sf):
    return P.table_shape(table(spark, sf, "lineitem"))


@query("column_profile", f"SELECT *, 0::INTEGER AS n_more FROM ({profile_sql(CUSTOMER_GAPS_SQL, CUSTOMER)}) p")
def column_profile(spark, sf):
    return P.column_profile(customer_gaps(spark, sf))


@query("column_profile_lineitem", f"SELECT *, 0::INTEGER AS n_more FROM ({profile_sql('SELECT * FROM lineitem', LINEITEM)}) p")
def column_profile_lineitem(spark, sf):
    return P.column_profile(table(spark, sf, "lineitem"))


@query("numeric_summary", summary_sql("SELECT * FROM lineitem", LINEITEM))
def numeric_summary(spark, sf):
    return P.numeric_summary(table(spark, sf, "lineitem"))


@query("numeric_summary_gaps", summary_sql(CUSTOMER_GAPS_SQL, CUSTOMER))
def numeric_summary_gaps(spark, sf):
    return P.numeric_summary(customer_gaps(spark, sf))


@query(
    "categorical_columns",
    f'SELECT position, "column", dtype, n_unique FROM ({profile_sql("SELECT * FROM lineitem", LINEITEM)}) p WHERE {CATEGORICAL}',
)
def categorical_columns(spark, sf):
    return P.categorical_columns(table(spark, sf, "lineitem"))


@query("value_counts", top_sql(CUSTOMER_GAPS_SQL, ["c_mktsegment", "c_nationkey"]))
def value_counts(spark, sf):
    return P.value_counts(customer_gaps(spark, sf), ["c_mktsegment", "c_nationkey"])


@query(
    "value_counts_default",
    f"""SELECT * FROM ({top_sql('SELECT * FROM part', [c for c, _ in PART])}) t WHERE "column" IN
    (SELECT "column" FROM ({profile_sql('SELECT * FROM part', PART)}) p WHERE {CATEGORICAL})""",
)
def value_counts_default(spark, sf):
    """The low-cardinality columns are found first."""
    return P.value_counts(table(spark, sf, "part"))


@query(
    "numeric_summary_approximate",
    "SELECT 'count' AS item, count(*)::DOUBLE AS value, true AS within, c AS \"column\" FROM lineitem, (VALUES "
    + ", ".join(f"('{c}')" for c, t in LINEITEM if t in ("bigint", "int", "double")) + ") n(c) GROUP BY c UNION ALL SELECT q, p, true, c FROM (VALUES "
    + ", ".join(f"('{c}')" for c, t in LINEITEM if t in ("bigint", "int", "double")) + ") n(c), (VALUES ('p25', 0.25::DOUBLE), ('p50', 0.5), ('p75', 0.75)) z(q, p)",
)
def numeric_summary_approximate(spark, sf):
    """Whether the true rank of every sketched quartile lies within the stated error of the wanted one."""
    lines = table(spark, sf, "lineitem")
    found = {r["column"]: r for r in P.numeric_summary(lines, digits=12, approximate=True).collect()}
    places = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    checks = []
    for c, r in found.items():
        checks.append(f"struct('{c}' AS column, 'count' AS item, CAST(count({c}) AS DOUBLE) AS value, count({c}) = {r['count']} AS within)")
        for q, p in places.items():
            below, upto = f"count_if({c} < {r[q]!r}D) / count({c})", f"count_if({c} <= {r[q]!r}D) / count({c})"
            checks.append(f"struct('{c}' AS column, '{q}' AS item, {p}D AS value, {below} <= {p + P.SKETCH_RANK_ERROR} AND {upto} >= {p - P.SKETCH_RANK_ERROR} AS within)")
    return lines.agg(F.expr(f"array({', '.join(checks)})").alias("checks")).select(F.inline("checks"))


# Seven frequent values among very many, short and long.
_HOT = "CASE WHEN l_orderkey % 4 = 0 THEN 'hot' || l_linenumber ELSE l_orderkey || '/' || l_partkey || '/' || l_linenumber END"
_LONG = f"repeat('words of a comment ', 5) || {_HOT}"
_FREQUENT = {"short": _HOT, "long": _LONG, "flag": "CASE WHEN l_linenumber < 3 THEN NULL ELSE l_returnflag END"}


@query(
    "frequent_values",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", v AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, v NULLS FIRST)::INTEGER AS rank, true AS certain
        FROM (SELECT {e} AS v FROM lineitem) s GROUP BY v) r WHERE rank <= 4""" for c, e in _FREQUENT.items()
    ),
)
def frequent_values_query(spark, sf):
    """Counters of the tasks first, then exact counts of the few values that may be frequent."""
    lines = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _FREQUENT.items()])
    found = frequent_values(lines, k=4)
    # Ties at the border are settled by value; the bound then equals the count.
    return found.select("column", "value", "n", "rank", (F.col("n") >= F.col("n_others")).alias("certain"))


_WIDE_SQL = "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {n}" for i, n in enumerate(WIDE)) + " FROM embeddings"


@query("profile_wide", summary_sql(_WIDE_SQL, [("vec_id", "bigint"), ("label", "bigint"), *((n, "double") for n in WIDE)]))
def profile_wide(spark, sf):
    """Every numeric column of a wide table is summarised."""
    return P.numeric_summary(wide_embeddings(spark, sf))


@query("head_sample", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def head_sample(spark, sf):
    return P.head_sample(table(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"])


_SUMMARY_ITEMS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
PROFILE_SQL = f"""
WITH prof AS ({profile_sql('SELECT * FROM part', PART)}), summ AS ({summary_sql('SELECT * FROM part', PART)}),
 cats AS (SELECT "column" FROM prof WHERE {CATEGORICAL}),
 tops AS ({top_sql('SELECT * FROM part', [c for c, _ in PART])})
SELECT 'shape' AS section, '' AS "column", 'n_rows' AS item, count(*)::DOUBLE AS value FROM part
UNION ALL SELECT 'shape', '', 'n_columns', 6.0
UNION ALL SELECT 'columns', "column", 'n_unique', n_unique::DOUBLE FROM prof
UNION ALL SELECT 'columns', "column", 'n_missing', n_missing::DOUBLE FROM prof
""" + " ".join(
    f"""UNION ALL SELECT 'numeric', "column", '{i}', "{i}"::DOUBLE FROM summ""" for i in _SUMMARY_ITEMS
) + """ UNION ALL SELECT 'values', "column", value, n::DOUBLE FROM tops WHERE "column" IN (SELECT "column" FROM cats)"""


@query("profile", PROFILE_SQL)
def profile(spark, sf):
    """All profile tables of one table, stacked."""
    found = P.profile(table(spark, sf, "part"), ["p_partkey"])

    def stack(df, section, items, column=F.col("column")):
        pairs = F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("value")) for i in items])
        return df.select(F.lit(section).alias("section"), column.alias("column"), F.inline(pairs))

    parts = [
        stack(found["shape"], "shape", ["n_rows", "n_columns"], F.lit("")),
        stack(found["columns"], "columns", ["n_unique", "n_missing"]),
        stack(found["numeric"], "numeric", _SUMMARY_ITEMS),
        found["value_counts"].select(
            F.lit("values").alias("section"), "column", F.col("value").alias("item"), F.col("n").cast("double").alias("value")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "class_distribution",
    """SELECT o_orderstatus AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
    FROM orders GROUP BY 1""",
)
def class_distribution(spark, sf):
    return P.class_distribution(table(spark, sf, "orders"), "o_orderstatus").withColumn("pct", F.round("pct", 6))


@query(
    "quality_notes",
    " UNION ALL ".join(
        f"""SELECT 'missing_share' AS note, '{c}' AS "column",
        round((count(*) - count({c}))::DOUBLE / count(*), 6) AS value FROM ({CUSTOMER_GAPS_SQL}) s""" for c, _ in CUSTOMER
    ) + f""" UNION ALL SELECT 'imbalance_ratio', 'c_mktsegment', round(max(n)::DOUBLE / min(n), 6) FROM (
      SELECT count(*) AS n FROM ({CUSTOMER_GAPS_SQL}) s GROUP BY coalesce(c_mktsegment, '')) z""",
)
def quality_notes(spark, sf):
    return P.quality_notes(customer_gaps(spark, sf), "c_mktsegment").withColumn("value", F.round("value", 6))


@query(
    "identifier_columns",
    f"""SELECT "column" FROM ({profile_sql('SELECT * FROM customer', CUSTOMER)}) p WHERE text_like AND n_unique > 0.5 * n_rows""",
)
def identifier_columns(spark, sf):
    return C.identifier_columns(table(spark, sf, "customer"))


@query(
    "feature_candidates",
    f"""SELECT "column", position, "numeric" FROM ({profile_sql(CUSTOMER_GAPS_SQL, CUSTOMER)}) p
    WHERE "column" <> 'c_mktsegment' AND NOT (text_like AND n_unique > 0.5 * n_rows)""",
)
def feature_candidates(spark, sf):
    return C.feature_candidates(customer_gaps(spark, sf), "c_mktsegment")


@query(
    "feature_candidates_documents",
    """SELECT 'lang' AS "column", 2::INTEGER AS position, false AS "numeric" WHERE (SELECT count(DISTINCT lang) <= 0.5 * count(*) FROM documents)
    UNION ALL SELECT 'text', 1, false WHERE (SELECT count(DISTINCT text) <= 0.5 * count(*) FROM documents)
    UNION ALL SELECT 'doc_id', 0, true""",
)
def feature_candidates_documents(spark, sf):
    """``source`` is a metadata name; ``text`` identifies its row when mostly distinct."""
    return C.feature_candidates(table(spark, sf, "documents"), "n_chars")


@query("drop_missing_target", f"SELECT c_custkey, c_mktsegment FROM ({CUSTOMER_GAPS_SQL}) s WHERE c_mktsegment IS NOT NULL")
def drop_missing_target(spark, sf):
    return C.drop_missing_target(customer_gaps(spark, sf), "c_mktsegment").select("c_custkey", "c_mktsegment")


_KEPT = ["e01", "e63"]


@query(
    "project_features",
    "SELECT vec_id, label, round(embedding[2]::DOUBLE, 6) AS e01, round(embedding[64]::DOUBLE, 6) AS e63 FROM embeddings",
)
def project_features(spark, sf):
    """Drop one, add one back in another case, keep only two."""
    df, _ = C.project_features(
        wide_embeddings(spark, sf), WIDE[:32], drop=["E05"], add=["E63"], keep_only=["e01", "E63", "e05"],
        always=["vec_id", "label"],
    )
    return df.withColumns({c: F.round(c, 6) for c in _KEPT})
