"""Ranking and metric tables as files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import local_table


def write_rankings(table: DataFrame, selected: Iterable[str], path: str, mode: str = "errorifexists") -> None:
    """``feature_rankings`` (CSV, ranks per method) and ``selected_features`` (text)."""
    table.coalesce(1).write.mode(mode).csv(f"{path}/feature_rankings", header=True)
    names = local_table(table.sparkSession, [(i, n) for i, n in enumerate(selected)], "pos int, value string")
    names.coalesce(1).sortWithinPartitions("pos").select("value").write.mode(mode).text(f"{path}/selected_features")


def write_metrics(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Metric tables as JSON lines, one folder per table (at most labels x labels rows)."""
    for name, table in tables.items():
        table.withColumn("table", F.lit(name)).write.mode(mode).json(f"{path}/{name}")
