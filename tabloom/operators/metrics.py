"""Classification metrics from free-text predictions.

Rows are read once: label extraction is a projection, and one count per
(split, truth, prediction) is the only shuffle. Every metric follows from that small
table of counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.labels import extract_label
from tabloom.operators.positions import positions
from tabloom.session import local_table, settle
from tabloom.spec import LabelMap

# Marker of an unreadable prediction, and the two error messages.
UNPARSED = "UNPARSED"
NO_LABELS = "No valid labels found in predictions"
NO_PREDICTIONS = "No valid predictions to evaluate"


def _read_labels(predictions: DataFrame, mapping: LabelMap) -> DataFrame:
    labels = mapping.labels
    return predictions.withColumns(
        {
            "truth": extract_label(F.col("label"), labels),
            "pred": F.coalesce(extract_label(F.col("predict"), labels), F.lit(UNPARSED)),
        }
    )


def score_rows(predictions: DataFrame, mapping: LabelMap) -> DataFrame:
    """Adds ``truth`` and ``pred``; rows without a truth are dropped, an empty
    prediction becomes UNPARSED."""
    return _read_labels(predictions, mapping).filter("truth IS NOT NULL")


def universe_labels(mapping: LabelMap) -> list[str]:
    labels = mapping.labels
    return labels if not labels or UNPARSED in labels else [*labels, UNPARSED]


def label_universe(scored: DataFrame, mapping: LabelMap) -> DataFrame:
    """``(split, pos, label)``: mapped labels in order, else the sorted truths of the
    split; UNPARSED last unless it is a label already.

    ``scored`` are scored rows or, cheaper, their pair counts.
    """
    splits = scored.select("split").distinct()
    known = universe_labels(mapping)
    if known:
        table = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(v).alias("label")) for i, v in enumerate(known)])
        return splits.select("split", F.inline(table))
    return _inferred_universe(scored.select("split", F.col("truth").alias("label")).distinct())


def _inferred_universe(truths: DataFrame) -> DataFrame:
    """Universe of splits without a mapping, from the distinct truths; numbered by ranges, however many there are."""
    marker = truths.select("split").distinct().withColumn("label", F.lit(UNPARSED))
    extra = marker.join(truths, ["split", "label"], "left_anti").withColumn("_last", F.lit(1))
    listed = truths.withColumn("_last", F.lit(0)).unionByName(extra)
    placed = positions(listed, ["_last", "label"], "pos", within=["split"])
    return placed.select("split", F.col("pos").cast("int").alias("pos"), "label")


def pair_counts(scored: DataFrame, mapping: LabelMap) -> DataFrame:
    """``(split, truth, pred, n)``; sides outside the universe are null.

    With a mapping they are folded before counting, so the groups are bounded by
    labels x labels whatever the texts are.
    """
    return _pairs(scored, mapping).filter("labelled").drop("labelled")


def _pairs(read: DataFrame, mapping: LabelMap) -> DataFrame:
    """Pair counts with rows lacking a truth counted too (``labelled`` is false)."""
    known = universe_labels(mapping)
    labelled = F.col("truth").isNotNull().alias("labelled")
    if known:
        inside = lambda c: F.when(F.col(c).isin(known), F.col(c)).alias(c)
        return read.groupBy("split", labelled, inside("truth"), inside("pred")).agg(F.count("*").alias("n"))
    counts = read.groupBy("split", labelled, "truth", "pred").agg(F.count("*").alias("n"))
    truths = (
        counts.filter("labelled").select("split", F.col("truth").alias("pred")).distinct()
        .withColumn("_in", F.lit(True))
    )
    joined = counts.join(truths, ["split", "pred"], "left")
    kept = F.when(F.col("_in") | (F.col("pred") == UNPARSED), F.col("pred"))
    return joined.groupBy("split", "labelled", "truth", kept.alias("pred")).agg(F.sum("n").alias("n"))


def _valid() -> Column:
    return F.col("truth").isNotNull() & F.col("pred").isNotNull()


def validity(counts: DataFrame) -> DataFrame:
    """``(split, total, valid, invalid, accuracy, error)`` from pair counts."""
    n = F.col("n")
    sums = counts.groupBy("split").agg(
        F.sum(n).alias("total"),
        F.coalesce(F.sum(F.when(_valid(), n)), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("truth") == F.col("pred"), n)), F.lit(0)).alias("_hits"),
    )
    return sums.select(
        "split",
        "total",
        "valid",
        (F.col("total") - F.col("valid")).alias("invalid"),
        F.try_divide(F.col("_hits").cast("double"), F.col("valid")).alias("accuracy"),
        F.when(F.col("valid") == 0, NO_PREDICTIONS).alias("error"),
    )


def accuracy(counts: DataFrame) -> DataFrame:
    return validity(counts).filter("valid > 0").select("split", "accuracy")


def label_scores(counts: DataFrame, universe: DataFrame) -> DataFrame:
    """Per split and label: precision, recall, f1, support and predictions, zeros included."""
    n = F.col("n")
    sides = F.array(
        F.struct(
            F.col("truth").alias("label"), n.alias("support"), F.lit(0).cast("long").alias("predicted"),
            F.when(F.col("truth") == F.col("pred"), n).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), n.alias("predicted"),
            F.lit(0).cast("long").alias("hits"),
        ),
    )
    sums = (
        counts.filter(_valid()).select("split", F.inline(sides)).groupBy("split", "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return (
        universe.join(sums, ["split", "label"], "left")
        .fillna(0, ["support", "predicted", "hits"])
        .select(
            "split", "pos", "label",
            share(hits, predicted).alias("precision"),
            share(hits, support).alias("recall"),
            share(2 * hits, support + predicted).alias("f1"),
            "support", "predicted",
        )
    )


def f1_scores(scores: DataFrame) -> DataFrame:
    """Macro F1 over the labels present on either side, and support-weighted F1."""
    present = (F.col("support") + F.col("predicted")) > 0
    return scores.groupBy("split").agg(
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def binary_f1(scores: DataFrame, binary_f1_on: str = "universe") -> DataFrame:
    """F1 of the first label, for splits with exactly two labels.

    The universe counts UNPARSED as a label; ``binary_f1_on="mapping"`` leaves the
    marker out of that count.
    """
    counted = F.lit(True) if binary_f1_on == "universe" else F.col("label") != UNPARSED
    return (
        scores.groupBy("split")
        .agg(F.count_if(counted).alias("_k"), F.max(F.when(F.col("pos") == 0, F.col("f1"))).alias("f1"))
        .filter("_k = 2").select("split", "f1")
    )


def confusion_matrix(counts: DataFrame, universe: DataFrame, dense: bool = True) -> DataFrame:
    """``(split, truth, pred, n)`` over the universe, zero cells included.

    The caller decides about the zero cells, the number of labels never does: the
    dense form has labels x labels rows per split, ``dense=False`` only the cells that
    occur, for universes inferred from free text.
    """
    cells = counts.filter(_valid()).select("split", "truth", "pred", "n")
    if not dense:
        return cells
    table, _ = settle(universe)
    columns = table.groupBy("split").agg(F.collect_list("label").alias("_preds"))
    grid = (
        table.join(columns, "split")
        .select("split", F.col("label").alias("truth"), F.explode("_preds").alias("pred"))
    )
    return grid.join(cells, ["split", "truth", "pred"], "left").fillna(0, ["n"])


def confusion_wide(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per truth, one column per predicted label."""
    return matrix.groupBy("split", "truth").pivot("pred", list(labels)).agg(F.sum("n")).fillna(0)


def classification_report(scores: DataFrame) -> DataFrame:
    """``(split, row, precision, recall, f1, support)``: labels, accuracy and averages.

    The macro average runs over all labels of the universe; accuracy stands in f1.
    """
    rows = scores.select("split", F.col("label").alias("row"), "precision", "recall", "f1", "support")
    s = F.col("support")
    means = scores.groupBy("split").agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(c) * s), F.sum(s)).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        F.sum(s).alias("support"),
    )
    none = F.lit(None).cast("double")

    def line(name, precision, recall, f1):
        return F.struct(
            F.lit(name).alias("row"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
            F.col("support").alias("support"),
        )

    # Recall weighted by support is the share of hits, that is accuracy.
    totals = F.array(
        line("accuracy", none, none, F.col("w_recall")),
        line("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
        line("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
    )
    return rows.unionByName(means.filter("support > 0").select("split", F.inline(totals)))


def evaluate(
    predictions: DataFrame,
    mapping: LabelMap,
    splits: Sequence[str] | None = None,
    binary_f1_on: str = "universe",
    dense: bool | None = None,
) -> dict[str, DataFrame]:
    """All metric tables of all splits from one pass over the predictions.

    ``splits`` names the splits that were handed in: one without any row gets an
    error row; splits not handed in are absent. ``dense`` (default: if there is a mapping) gives the
    zero cells of the confusion matrix too, labels x labels of them; a universe inferred from free text may be of any size.
    """
    spark = predictions.sparkSession
    pairs, _ = settle(_pairs(_read_labels(predictions, mapping), mapping))
    counts = pairs.filter("labelled").drop("labelled")
    present = pairs.select("split").distinct()
    known = universe_labels(mapping)
    if known:
        table = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(v).alias("label")) for i, v in enumerate(known)])
        universe = present.select("split", F.inline(table))
    else:
        universe = _inferred_universe(
            counts.filter("truth IS NOT NULL").select("split", F.col("truth").alias("label")).distinct()
        )
    scores = label_scores(counts, universe)
    checked = validity(counts)
    usable = checked.filter("valid > 0").select("split")
    scores = scores.join(usable, "split", "left_semi")
    binary = binary_f1(scores, binary_f1_on)
    averages = f1_scores(scores).join(binary, "split", "left_anti")
    summary = checked.join(binary, "split", "left").join(averages, "split", "left")
    listed = present if splits is None else local_table(spark, [(s,) for s in splits], "split string")
    summary = (
        listed.join(summary, "split", "left")
        .withColumn("error", F.when(F.col("total").isNull(), NO_LABELS).otherwise(F.col("error")))
        .fillna(0, ["total", "valid", "invalid"])
    )
    return {
        "summary": summary,
        "labels": universe,
        "confusion": confusion_matrix(counts, universe.join(usable, "split", "left_semi"), bool(known) if dense is None else dense),
        "report": classification_report(scores),
    }
