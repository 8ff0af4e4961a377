"""The stateless steps on a stream.

Example building, label extraction, payload extraction and override parsing are
projections, so the same functions take a streaming table. What a stream cannot
give is a fitted median: fit the spec on a batch table first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.functions.labels import extract_label
from tabloom.operators.examples import build_examples
from tabloom.spec import LabelMap, PrepSpec


def stream_examples(rows: DataFrame, spec: PrepSpec) -> DataFrame:
    return build_examples(rows, spec)


def stream_labels(predictions: DataFrame, mapping: LabelMap) -> DataFrame:
    """Adds the label read from each prediction text."""
    return predictions.withColumn("pred", extract_label(F.col("predict"), mapping.labels))


def append_to(rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process everything available now and append it to files exactly once.

    ``checkpoint`` is a folder on shared storage; a restart goes on from it.
    """
    return (
        rows.writeStream.format(fmt).outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
