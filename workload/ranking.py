"""Feature-ranking queries over the widened embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import features as FE
from tabloom.operators.forest import baseline_predict, rank_forest
from tabloom.operators.neighbours import digamma, rank_mutual_info_knn
from tabloom.operators.split import stratified_split
from workload.inputs import GAP_VARIANCE, TALL_GAPS_SQL, TALL_SQL, VARIANCE, WIDE, wide_embeddings, wide_gaps
from workload.preparing import stratified_sql
from workload.registry import query, table

FILLED_SQL = f"""SELECT vec_id, label, g.i, g.feature, coalesce(v, m) AS v FROM ({TALL_GAPS_SQL}) g
  JOIN (SELECT i, median(v) AS m FROM ({TALL_GAPS_SQL}) a GROUP BY i) b ON g.i = b.i"""
KEPT_SQL = f"SELECT feature FROM ({FILLED_SQL}) f GROUP BY feature HAVING var_pop(v) > {GAP_VARIANCE}"


def correlation_sql(source: str) -> str:
    return f"""SELECT 'correlation' AS method, feature, round(coalesce(abs(corr(v, label)), 0), 9) AS score
      FROM ({source}) t GROUP BY feature"""


def mutual_info_sql(source: str) -> str:
    return f"""SELECT 'mutual_info' AS method, feature, round(greatest(sum(n * 1.0::DOUBLE / nn * ln(n * 1.0::DOUBLE * nn / (nb::DOUBLE * ny))), 0), 9) AS score
      FROM (SELECT *, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, label) AS ny,
                   sum(n) OVER (PARTITION BY feature) AS nn
            FROM (SELECT t.feature, label, len(list_filter(e, lambda z: z < v)) AS b, count(*) AS n FROM ({source}) t
                  JOIN (SELECT feature, quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM ({source}) q GROUP BY feature) ed
                  ON t.feature = ed.feature GROUP BY ALL) c) w GROUP BY feature"""


def ranked_sql(scores: str) -> str:
    return f"""SELECT method, feature, score, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) - 1 AS rank
      FROM ({scores}) s"""


def shown(ranked: str) -> str:
    return f"SELECT method, feature, round(score, 6) AS score, rank::INTEGER AS rank FROM ({ranked}) r"


def show(df):
    return df.withColumn("score", F.round("score", 6))


KEPT_ROWS = f"SELECT * FROM ({FILLED_SQL}) f WHERE feature IN ({KEPT_SQL})"
ENSEMBLE = f"({ranked_sql(correlation_sql(KEPT_ROWS))}) UNION ALL ({ranked_sql(mutual_info_sql(KEPT_ROWS))})"
TOP_SQL = f"""SELECT feature, avg(rank) AS avg_rank FROM ({ENSEMBLE}) r GROUP BY feature
   ORDER BY avg_rank, feature LIMIT 32"""
FAST = ("correlation", "mutual_info")


@query("impute_median", f"SELECT vec_id, feature, round(v, 6) AS v FROM ({FILLED_SQL}) f")
def impute_median(spark, sf):
    filled = FE.impute_median(wide_gaps(spark, sf), WIDE)
    return filled.select("vec_id", *WIDE).unpivot("vec_id", WIDE, "feature", "v").withColumn("v", F.round("v", 6))


@query(
    "variance_filter",
    f"""SELECT feature, round(var_pop(v), 6) AS variance, var_pop(v) > {VARIANCE} AS kept FROM ({TALL_SQL}) t GROUP BY feature""",
)
def variance_filter(spark, sf):
    return FE.column_variances(wide_embeddings(spark, sf), WIDE, VARIANCE).withColumn("variance", F.round("variance", 6))


@query(
    "encode_label",
    """SELECT o_orderkey, o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS y_code FROM orders""",
)
def encode_label(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return FE.encode_label(rows, "o_orderpriority")


@query(
    "encode_label_many",
    """SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey AS line, (dense_rank() OVER (ORDER BY l_orderkey || '|' || l_linenumber || '|' || l_partkey)
      - 1)::INTEGER AS y_code FROM lineitem""",
)
def encode_label_many(spark, sf):
    """A class for every line item."""
    rows = table(spark, sf, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey").alias("line"))
    return FE.encode_label(rows, "line")


@query("rank_correlation", shown(ranked_sql(correlation_sql(TALL_SQL))))
def rank_correlation(spark, sf):
    return show(FE.rank_correlation(wide_embeddings(spark, sf), WIDE, "label"))


@query(
    "rank_correlation_text",
    f"""SELECT 'correlation' AS method, f AS feature, round(s, 6) AS score,
      (row_number() OVER (ORDER BY round(s, 9) DESC, f) - 1)::INTEGER AS rank FROM (
      SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS f,
        unnest([abs(corr(l_quantity, y)), abs(corr(l_extendedprice, y)), abs(corr(l_discount, y)), abs(corr(l_tax, y))]) AS s
      FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem) z) q""",
)
def rank_correlation_text(spark, sf):
    """A text target is encoded in label order first."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return show(FE.rank_correlation(table(spark, sf, "lineitem").select("l_returnflag", *columns), columns, "l_returnflag"))


@query("rank_mutual_info", shown(ranked_sql(mutual_info_sql(TALL_SQL))))
def rank_mutual_info(spark, sf):
    return show(FE.rank_mutual_info(wide_embeddings(spark, sf), WIDE, "label"))


_REGRESSION_TALL = """SELECT feature, v, len(list_filter((SELECT quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM lineitem),
   lambda z: z < l_extendedprice)) AS label FROM (
   SELECT l_extendedprice, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) u"""


@query("rank_mutual_info_regression", shown(ranked_sql(mutual_info_sql(_REGRESSION_TALL))))
def rank_mutual_info_regression(spark, sf):
    """A regression target is binned like a feature."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    rows = table(spark, sf, "lineitem").select("l_extendedprice", *columns)
    return show(FE.rank_mutual_info(rows, columns, "l_extendedprice", "regression"))


@query("rank_forest")
def rank_forest_query(spark, sf):
    return rank_forest(wide_embeddings(spark, sf), WIDE, "label", key=["vec_id"])


def _selection(spark, sf, methods=FAST):
    return FE.select_features(
        wide_gaps(spark, sf), "label", key=["vec_id"], methods=methods, threshold=GAP_VARIANCE, exclude=["vec_id"]
    )


@query(
    "aggregate_ranks",
    f"""SELECT feature, round(avg_rank, 6) AS avg_rank, (row_number() OVER (ORDER BY avg_rank, feature) - 1)::INTEGER AS position
    FROM (SELECT feature, avg(rank) AS avg_rank FROM (({ranked_sql(correlation_sql(TALL_SQL))}) UNION ALL ({ranked_sql(mutual_info_sql(TALL_SQL))})) r
    GROUP BY feature ORDER BY avg_rank, feature LIMIT 10) t""",
)
def aggregate_ranks(spark, sf):
    df = wide_embeddings(spark, sf)
    both = FE.rank_correlation(df, WIDE, "label").unionByName(FE.rank_mutual_info(df, WIDE, "label"))
    return FE.aggregate_ranks(both, 10).withColumn("avg_rank", F.round("avg_rank", 6))


@query(
    "select_features",
    f"""WITH top AS ({TOP_SQL})
    SELECT 'selected' AS status, feature, (row_number() OVER (ORDER BY avg_rank, feature) - 1)::INTEGER AS position FROM top
    UNION ALL SELECT 'dropped', feature, -1 FROM (SELECT DISTINCT feature FROM ({TALL_SQL}) t) a
      WHERE feature NOT IN (SELECT feature FROM top)""",
)
def select_features(spark, sf):
    """Imputed, variance-filtered, ranked by two methods, top half kept."""
    from tabloom.session import local_table

    found = _selection(spark, sf)
    rows = [("selected", f, i) for i, f in enumerate(found.selected)] + [("dropped", f, -1) for f in found.dropped]
    return local_table(spark, rows, "status string, feature string, position int")


@query("select_features_forest")
def select_features_forest(spark, sf):
    """The full ensemble with the forest."""
    found = _selection(spark, sf, FE.METHODS)
    return FE.rankings_table(found.rankings, found.ranked)


@query(
    "rankings_table",
    f"""SELECT t.feature, max(CASE WHEN method = 'correlation' THEN rank END)::INTEGER AS correlation_rank,
      max(CASE WHEN method = 'mutual_info' THEN rank END)::INTEGER AS mutual_info_rank, (-1)::INTEGER AS random_forest_rank
    FROM ({TOP_SQL}) t JOIN ({ENSEMBLE}) r ON t.feature = r.feature GROUP BY t.feature""",
)
def rankings_table(spark, sf):
    found = _selection(spark, sf)
    return FE.rankings_table(found.rankings, found.ranked)


@query("baseline_predict")
def baseline_query(spark, sf):
    """Fit on the training side of the orders, predict both sides."""
    columns = ["o_totalprice", "o_custkey"]
    rows = stratified_split(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"])
    train = rows.filter("split = 'train'").drop("split")
    test = rows.filter("split = 'test'").drop("split")
    return baseline_predict(train, test, columns, "o_orderstatus", key=["o_orderkey"])


@query(
    "rank_forest_signal",
    """SELECT 'random_forest' AS method, 'signal' AS feature, 0::INTEGER AS rank, 65::BIGINT AS n_features, 1.0::DOUBLE AS total""",
)
def rank_forest_signal(spark, sf):
    """A feature that is the label with a little noise comes first; scores add up to one."""
    rows = wide_embeddings(spark, sf).withColumn("signal", F.col("label") + F.col("e00") / 10)
    ranks = rank_forest(rows, [*WIDE, "signal"], "label", key=["vec_id"], n_trees=20, max_depth=5)
    first = F.min_by(F.struct("method", "feature", F.col("rank").cast("int").alias("rank")), "rank")
    return ranks.agg(first.alias("first"), F.count("*").alias("n_features"), F.round(F.sum("score"), 6).alias("total")).select(
        "first.*", "n_features", "total")


@query(
    "baseline_rows",
    """SELECT split, count(*) AS n, count(*) AS known, count(DISTINCT o_orderkey) AS n_keys FROM (""" + stratified_sql(
        "SELECT * FROM orders", "o_orderstatus", "o_orderkey", "0.2", "o_orderkey, split") + """) s GROUP BY 1""",
)
def baseline_rows(spark, sf):
    """Every row of both sides gets a prediction that is one of the classes."""
    rows = baseline_query(spark, sf)
    known = F.count_if(F.col("predict").isin("F", "O", "P"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), known.alias("known"), F.count_distinct("o_orderkey").alias("n_keys"))


def mutual_info_knn_sql(source: str, k: int = 3) -> str:
    """All pairs of one feature and class for the distances, all pairs of one feature for the counts."""
    return f"""WITH p AS (SELECT vec_id, feature, label, v, count(*) OVER (PARTITION BY feature, label) AS c FROM ({source}) t WHERE v IS NOT NULL),
      q AS (SELECT *, least({k}, c - 1) AS kk FROM p WHERE c > 1),
      d AS (SELECT a.vec_id, a.feature, a.v, a.kk, a.c, abs(b.v - a.v) AS dist,
              row_number() OVER (PARTITION BY a.feature, a.vec_id ORDER BY abs(b.v - a.v)) AS r
            FROM q a JOIN q b ON a.feature = b.feature AND a.label = b.label AND a.vec_id <> b.vec_id),
      m AS (SELECT d.feature, d.vec_id, any_value(d.kk) AS kk, any_value(d.c) AS c,
              count(*) FILTER (abs(b.v - d.v) < d.dist OR b.v = d.v) AS m
            FROM d JOIN q b ON b.feature = d.feature WHERE d.r = d.kk GROUP BY 1, 2),
      s AS (SELECT feature, count(*) AS n, avg({digamma('kk')}) AS a, avg({digamma('c')}) AS b, avg({digamma('m')}) AS e FROM m GROUP BY 1)
    SELECT 'mutual_info' AS method, feature, round(greatest({digamma('n')} + a - b - e, 0), 9) AS score FROM s"""


@query("rank_mutual_info_knn", shown(ranked_sql(mutual_info_knn_sql(TALL_GAPS_SQL))))
def rank_mutual_info_knn_query(spark, sf):
    """Three neighbours, missing values left out."""
    return show(rank_mutual_info_knn(wide_gaps(spark, sf), WIDE, "label"))
