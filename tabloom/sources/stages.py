"""Stage tables: every stage writes its result, a later one may start from it.

A stage is written to a folder of its own attempt. Only when that is complete, a manifest is published that names it; readers follow manifests
and take the newest of their run. A write that dies leaves no manifest, so the stage before it stays as it was, and nothing is ever
overwritten in place. The manifest keeps what the stage was made with, and a reader who asks for something else is told.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import local_table

RUN = "run_id"
MANIFEST = "stage string, run_id string, version bigint, attempt string, path string, n_rows bigint, table_schema string, parameters string, fingerprint string"


class StageMismatch(ValueError):
    """A saved stage was made with other parameters than those asked for."""


def fingerprint(parameters: Mapping[str, object]) -> tuple[str, str]:
    """The parameters as text in a fixed order, and its digest."""
    text = json.dumps(parameters, sort_keys=True, ensure_ascii=False, default=str)
    return text, hashlib.sha256(text.encode()).hexdigest()


def _folder(root: str, stage: str) -> str:
    return f"{root.rstrip('/')}/{stage}"


def manifests(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """All published manifests of a stage, of every run and version."""
    try:
        return spark.read.schema(MANIFEST).json(f"{_folder(root, stage)}/manifest")
    except AnalysisException:
        return local_table(spark, [], MANIFEST)


def _newest(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """The manifest that counts of each run. Two writers of one version are told apart by attempt."""
    order = Window.partitionBy(RUN).orderBy(F.desc("version"), F.desc("attempt"))
    return manifests(spark, root, stage).withColumn("_age", F.row_number().over(order)).filter("_age = 1").drop("_age")


def write_stage(
    df: DataFrame, root: str, run_id: str, stage: str, parameters: Mapping[str, object] | None = None
) -> DataFrame:
    """Write one stage of one run and return the table as read back.

    The result starts from files, so nothing upstream is recomputed when an executor
    is lost. Other runs of the stage, and older versions of this one, are left alone.
    """
    spark = df.sparkSession
    attempt = uuid.uuid4().hex
    path = f"{_folder(root, stage)}/data/{RUN}={run_id}/{attempt}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    before = manifests(spark, root, stage).filter(F.col(RUN) == run_id).agg(F.max("version")).first()[0]
    text, digest = fingerprint(parameters or {})
    row = (stage, run_id, (before or 0) + 1, attempt, path, written.count(), df.schema.json(), text, digest)
    local_table(spark, [row], MANIFEST).coalesce(1).write.mode("append").json(f"{_folder(root, stage)}/manifest")
    return written


def read_stage(
    spark: SparkSession, root: str, run_id: str, stage: str, parameters: Mapping[str, object] | None = None
) -> DataFrame:
    """The newest complete table of a stage of a run. Parameters that are given must be those that it was made with."""
    found = _newest(spark, root, stage).filter(F.col(RUN) == run_id).first()
    if found is None:
        raise FileNotFoundError(f"no stage {stage!r} of run {run_id!r} under {root}")
    made, wanted = json.loads(found["parameters"]), json.loads(fingerprint(parameters or {})[0])
    other = sorted(name for name, value in wanted.items() if name not in made or made[name] != value)
    if other:
        told = "; ".join(f"{name}: {made.get(name)!r}, not {wanted[name]!r}" for name in other)
        raise StageMismatch(f"stage {stage!r} of run {run_id!r} was made with {told}")
    return spark.read.parquet(found["path"])


def stage_runs(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """Rows per kept run of a stage, from the manifests."""
    return _newest(spark, root, stage).select(RUN, "n_rows")
