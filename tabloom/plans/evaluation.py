"""The scoring path: prediction files to metric files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.metrics import evaluate
from tabloom.sources.examples import read_predictions
from tabloom.sources.reports import write_metrics
from tabloom.spec import LabelMap


def score_files(
    spark: SparkSession, files: Mapping[str, str], mapping: LabelMap, out: str | None = None, damaged: str = "fail",
    dense: bool | None = None,
) -> dict[str, DataFrame]:
    """Evaluate prediction files, ``{split: path}``, in one pass; optionally write the tables.

    A damaged line fails the job. With ``damaged="report"`` the metrics cover the other
    lines, and the summary counts the damaged ones per split as ``n_damaged``. ``dense``: see ``evaluate``.
    """
    if not files:
        raise ValueError("no prediction files")
    parts = [read_predictions(spark, path, name, damaged) for name, path in files.items()]
    lines = reduce(DataFrame.unionByName, parts)
    if damaged == "report":
        tables = evaluate(lines.filter("NOT damaged").drop("damaged"), mapping, list(files), dense=dense)
        counts = lines.groupBy("split").agg(F.count_if("damaged").alias("n_damaged"))
        tables["summary"] = tables["summary"].join(counts, "split", "left").fillna(0, ["n_damaged"])
    else:
        tables = evaluate(lines, mapping, list(files), dense=dense)
    if out is not None:
        write_metrics(tables, out)
    return tables
