"""Example sets and predictions as files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.payload import STRICT_JSON, is_one_json_object
from tabloom.sources.blocks import JSON, read_records
from tabloom.spec import EXAMPLE_SCHEMA

FILE_FORMATS = ("json", "parquet")

# Accepted field names of a prediction record, first hit wins.
PREDICT_FIELDS = ("predict", "prediction")
LABEL_FIELDS = ("label", "ground_truth")


def read_examples(
    spark: SparkSession, path: str, fmt: str = "array", partitions: int | None = None, block_bytes: int | None = None
) -> DataFrame:
    """Example set: "array" (one JSON array per file), "json" (lines) or "parquet".

    An array file is cut at its records by many tasks (see ``blocks``; ``block_bytes`` sets the size of a block), whatever its
    line breaks. A record that is no example gives a row of nulls. ``partitions`` spreads the rows of few large blocks.
    """
    if fmt == "array":
        schema = EXAMPLE_SCHEMA.simpleString()
        rows = read_records(spark, path, JSON, lambda c: F.from_json(F.ltrim(c, F.lit("[,\ufeff \t\r\n")), schema), block_bytes).drop("_first")
        return rows.repartition(partitions) if partitions else rows
    if fmt == "json":
        return spark.read.schema(EXAMPLE_SCHEMA).json(path)
    return spark.read.format(fmt).load(path)


def write_examples(
    df: DataFrame, path: str, fmt: str = "json", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write examples as JSON lines or Parquet, one folder per ``partition_by`` value."""
    if fmt not in FILE_FORMATS:
        raise ValueError(f"format must be one of {FILE_FORMATS}, not {fmt!r}")
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def array_lines(records: DataFrame) -> DataFrame:
    """The text of one JSON array in one partition, to be written as one file, from a table of one text column with a JSON object a row.

    Records pass through the task in any order, a batch at a time, so its memory does not grow with them. A table planned as
    empty may give no text at all, which ``read_examples`` reads as no rows too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(values: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

        yield lines(["["])
        comma = ""
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield lines([("," if i else comma) + v for i, v in enumerate(values)])
            comma = "," if values else comma
        yield lines(["]"])

    return records.coalesce(1).mapInArrow(run, "value string")


def read_predictions(
    spark: SparkSession, path: str, split: str | None = None, damaged: str = "fail"
) -> DataFrame:
    """Prediction lines as ``(label, predict)``, with ``split`` when given.

    Blank lines are skipped; an empty file gives no rows. A missing field is read
    from its alternative name, else it is the empty text. A line that is not one JSON
    object fails the job; with ``damaged="report"`` it is kept as a row of empty texts,
    told apart by a further boolean column ``damaged``.
    """
    if damaged not in ("fail", "report"):
        raise ValueError(f"damaged must be fail or report, not {damaged!r}")
    fields = ", ".join(f"{f} string" for f in (*PREDICT_FIELDS, *LABEL_FIELDS))
    lines = spark.read.text(path).filter(F.trim(F.translate("value", "\t\r", "  ")) != "")
    broken = ~is_one_json_object(F.col("value"))
    if damaged == "fail":
        error = F.raise_error(F.concat(F.lit("damaged prediction line: "), F.substring("value", 1, 200)))
        # A filter, so that the check also runs where no column is read.
        lines = lines.filter(F.when(broken, error.cast("boolean")).otherwise(True))
    record = F.from_json("value", fields, STRICT_JSON)

    def first_of(names):
        return F.coalesce(*[F.when(~F.col("damaged"), F.col("record")[n]) for n in names], F.lit(""))

    rows = lines.select(broken.alias("damaged"), record.alias("record")).select(
        *([] if split is None else [F.lit(split).alias("split")]),
        first_of(LABEL_FIELDS).alias("label"), first_of(PREDICT_FIELDS).alias("predict"), "damaged",
    )
    return rows if damaged == "report" else rows.drop("damaged")
