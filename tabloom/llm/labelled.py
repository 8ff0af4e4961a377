"""Bounded samples of labelled documents for fitting classifiers.

Labels count only where the CRC-32 of the id, written as text, is not divisible by
``FOLDS``; the other documents are held out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stage, text_of

FOLDS = 5


def held_out(doc_id: str) -> Column:
    """Whether a document is held out; false without id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def counts(labels: DataFrame, label: str) -> dict[int, int]:
    """Labelled rows that may be learned from, by label."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out("doc_id"))
    return {int(r[0]): r[1] for r in usable.groupBy(label).count().collect()}


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], most_bytes: int) -> DataFrame:
    """``(doc_id, _text, label)``: up to ``per_class[c]`` labelled documents of each class,
    the first in the order of a hash of the id, staged. Longer documents than
    ``most_bytes`` are not fitted on (all are scored)."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out("doc_id") & F.col("doc_id").isNotNull())
    ids = None
    for value, rows in sorted(per_class.items()):
        one = usable.filter(F.col(label) == value).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
        one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = one if ids is None else ids.unionAll(one)
    texts = docs.select("doc_id", text_of("text").alias("_text")).filter(F.octet_length("_text") <= most_bytes)
    # The list of ids is bounded by per_class.
    return stage(texts.join(F.broadcast(stage(ids, "fitids")), "doc_id"), "fitted")
